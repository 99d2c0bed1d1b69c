"""Fixed values that decide results.

Every list here is data that must keep exactly these entries and this order,
because each one changes which secrets are reported or how they are shown. The
signature rules are the other fixed table; they live in ``data/rules.json``.
"""

# File extensions that are scanned (compared in lower case).
VALID_EXTENSIONS = [".go", ".js", ".ts", ".py", ".env", ".json", ".yaml", ".yml", ".txt", ".c"]

# Directory names whose whole subtree is skipped.
SKIP_DIRS = [".git", "node_modules", "vendor", "dist", "build"]

# File names that are skipped although their extension is scanned.
SKIP_FILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "composer.lock", ".DS_Store",
]

# Fixed value: largest blob scanned in a commit tree, in bytes (history only).
MAX_BLOB_BYTES = 500 * 1024

# Fixed value: a line of this many bytes or more ends the scan of its file.
LINE_LIMIT_BYTES = 1024 * 1024

# Keywords with two or more words.
COMPOUND_KEYWORDS = [
    "api_key", "apikey", "api-key",
    "secret_key", "secretkey", "secret-key",
    "passwd", "pwd",
    "auth_token", "access_token", "accesstoken",
    "client_secret", "clientsecret",
    "private_key", "privatekey",
    "aws_access_key_id", "aws_secret_access_key",
]

# Single-word keywords.
GENERIC_KEYWORDS = [
    "key", "secret", "password",
    "token", "auth", "authorization", "bearer",
    "credential", "credentials",
]

# Fixed value: what may follow a keyword; group 1 is the reported value.
KEYWORD_TAIL = r"""\s*[:=]\s*["']?([A-Za-z0-9+/=_\-.@:]{8,})["']?"""

# A keyword value that contains one of these (in upper case) is no secret.
PLACEHOLDERS = ["XXXX", "CHANGEME", "YOUR_", "EXAMPLE", "TEST", "PLACEHOLDER"]

# Fixed value: shortest keyword value, in bytes.
MIN_VALUE_BYTES = 8

# Types given to findings that no signature rule names.
KEYWORD_TYPE = "Keyword Secret"
ENTROPY_TYPE = "High Entropy String"

# Characters of a token, its shortest length and its entropy bound in bits.
TOKEN_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
MIN_TOKEN_LENGTH = 30
ENTROPY_BOUND = 5.0

# A token that contains one of the first (in lower case), or starts with the last, is noise.
NOISE_WORDS = ["sha256", "md5", "base64", "-----begin", "-----end"]
NOISE_PREFIX = "eyj"

# Fixed value: a token with a run of more than this many equal characters is noise.
MAX_REPEAT_RUN = 6

# Prefixes that stay readable in a redacted secret; the first that fits wins.
VISIBLE_PREFIXES = [
    "sk-proj-", "sk-ant-api03-", "sk-", "ghp_", "gho_", "github_pat_", "glpat-",
    "xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-", "eyJ", "AKIA", "ASIA", "dop_v1_", "pat",
    "whsec_", "sk_live_", "sk_test_", "rk_live_", "rk_test_", "hf_", "gsk_", "tvly-", "xai-",
    "AIza", "GOCSPX-", "ya29.", "PMAK-", "----",
]

# What may stand between BEGIN or END and the closing dashes of a block of several lines, and the type of such findings.
BLOCK_LABEL = r"(?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?"
BLOCK_TYPE = "Private Key Block"
