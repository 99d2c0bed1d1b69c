"""Random text that matches, or nearly matches, a rule pattern."""

import random

import string

try:
    from re import _constants as sre, _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as parser

_ANY = [c for c in string.printable if c not in "\n\r\x0b\x0c"]


def _members(items) -> list[str]:
    chars: list[str] = []
    negated = False
    for kind, value in items:
        if kind is sre.NEGATE:
            negated = True
        elif kind is sre.LITERAL:
            chars.append(chr(value))
        elif kind is sre.RANGE:
            chars += [chr(c) for c in range(value[0], value[1] + 1)]
        elif kind is sre.CATEGORY:
            chars += {sre.CATEGORY_SPACE: " \t", sre.CATEGORY_DIGIT: string.digits,
                      sre.CATEGORY_WORD: string.ascii_letters + string.digits + "_"}[value]
    return [c for c in _ANY if c not in chars] if negated else chars


def _walk(tree, rng: random.Random) -> str:
    out = []
    for kind, value in tree:
        if kind is sre.LITERAL:
            out.append(chr(value))
        elif kind is sre.NOT_LITERAL:
            out.append(rng.choice([c for c in _ANY if c != chr(value)]))
        elif kind is sre.ANY:
            out.append(rng.choice(_ANY))
        elif kind is sre.IN:
            out.append(rng.choice(_members(value)))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            count = rng.choice([low, min(int(high), low + 3), min(int(high), low + rng.randint(0, 30))])
            out += [_walk(inner, rng) for _ in range(count)]
        elif kind is sre.SUBPATTERN:
            out.append(_walk(value[3], rng))
        elif kind is sre.BRANCH:
            out.append(_walk(rng.choice(value[1]), rng))
        elif kind is not sre.AT:
            raise ValueError(kind)
    return "".join(out)


def sample(pattern: str, rng: random.Random) -> str:
    """A match of the pattern between random neighbours, sometimes damaged or with folded letters."""
    text = _walk(parser.parse(pattern), rng)
    if pattern.startswith("(?i)"):
        text = "".join(rng.choice([c, c.swapcase(), {"k": "K", "s": "ſ"}.get(c.lower(), c)])
                       if rng.random() < 0.15 else c for c in text)
    if rng.random() < 0.2 and text:
        cut = rng.randrange(len(text))
        text = text[:cut] + rng.choice(["", "\x0b", "é", " ", "=", "K"]) + text[cut + 1:]
    ends = ["", " ", "a", "_", "é", "\x0b", "K", '"', "-", "\t", "9", " "]
    return rng.choice(ends) + text + rng.choice(ends)


def samples(patterns, per_pattern: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [line for p in patterns for line in (sample(p, rng) for _ in range(per_pattern)) if "\n" not in line]


