"""Cheap tests that a line must pass before the exact detectors look at it.

Each guard is implied by its detector, so it never changes a result; it only
keeps the costly patterns away from most lines. Character sets are spelled out
because Java compares one bit set per character then, and every pattern starts with
a set that few characters belong to.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from keysweep.functions.entropy import TOKEN_CLASS
from keysweep.fixed_values import MIN_TOKEN_LENGTH, TOKEN_ALPHABET
from keysweep.sources.rules import Rule

_SPACE = r"[\t\n\f\r ]"
_VALUE = "[" + TOKEN_ALPHABET.replace("-", r"\-") + ".@:]"

# So many token characters in a row: the key itself, in most rules.
_RUN = TOKEN_CLASS + "{27}"
# First letters of the words that name a setting: supabase, sasl, security, bootstrap.
_CONTEXT = "[sSbB][uUaAeEoO][pPsScCoO][aAlLuUtT][bB.rRsS][aAuUpPiItT]"
# A separator behind the last letter of a keyword or a space, and a value.
_ASSIGNED = rf"[:=](?<=[yYdDnNtThHrRlLsS\t\n\f\r ][:=]){_SPACE}*[\"']?{_VALUE}{{8}}"
# The ends of all keywords, as _folded() writes them; the lookahead fails fast on most positions.
_KEYWORD = ("(?=[kKpPsStT_aAbBcC\u017f\u212a][eEaAwWoOiIuUrR])"
            "(?iu:key|passwd|pwd|secret|token|_id|password|auth|authorization|bearer|credentials?)"
            rf"(?iu:{_SPACE}*[:=]{_SPACE}*[\"']?[A-Za-z0-9+/=_\-.@:]{{8}})")
_TOKEN = TOKEN_CLASS + f"{{{MIN_TOKEN_LENGTH}}}"


def _at_least(text: Column, size: int) -> Column:
    """Spares short lines the pattern behind it."""
    return F.octet_length(text) >= size


def folds_to_ascii(text: Column) -> Column:
    """Long s and the Kelvin sign count as ``s`` and ``k`` in patterns that ignore case."""
    return text.contains("\u017f") | text.contains("\u212a")


def keyword_guard(line: Column) -> Column:
    return _at_least(line, 12) & (line.rlike(_ASSIGNED) | folds_to_ascii(line)) & line.rlike(_KEYWORD)


def token_guard(line: Column) -> Column:
    return _at_least(line, MIN_TOKEN_LENGTH) & line.rlike(_TOKEN)


# What a rule's "gate" names; the test takes a line and the stems of all rules with that gate.
RULE_GATES = {
    "run": lambda line, stems: _at_least(line, 27) & line.rlike(_RUN),
    "url": lambda line, stems: line.contains("://"),
    "context": lambda line, stems: _at_least(line, 6) & line.rlike(_CONTEXT),
    "stem": lambda line, stems: _any(line.contains(s) for s in stems),
}


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _gate(rule: Rule) -> str | None:
    if rule.gate == "stem" and (rule.folds_case or not rule.stems):
        return None  # only literals in one fixed case are looked for on every line
    return rule.gate if rule.gate in RULE_GATES else None


def open_rules(rules: list[Rule]) -> list[Rule]:
    """Rules without a usable gate; nothing is known about the lines they match."""
    return [r for r in rules if _gate(r) is None]


def passes_gates(line: Column, rules: list[Rule], which) -> Column:
    """Whether a line may hold a finding of the chosen detectors. Open rules are not looked at."""
    gated = [(_gate(r), r) for r in rules] if "signature" in which else []
    stems = {gate: [s for g, r in gated if g == gate for s in r.stems] for gate, _ in gated}
    tests = [test(line, stems[gate]) for gate, test in RULE_GATES.items() if gate in stems]
    if stems and any(r.folds_case for r in rules):
        tests.append(folds_to_ascii(line))
    if "entropy" in which and "run" not in stems:  # a token is a run, too
        tests.append(token_guard(line))
    if "keyword" in which:
        tests.append(keyword_guard(line))
    return _any(tests)


def _folded(literals) -> str:
    """One pattern for literals in any case; the lookahead on two letters fails fast on most positions."""
    literals = sorted(set(literals))
    width = min(2, min(map(len, literals)))
    starts = ("".join(sorted({v for s in literals for v in _variants(s[at])})) for at in range(width))
    ahead = "".join(f"[{re.escape(chars)}]" for chars in starts)
    return f"(?={ahead})(?iu:" + "|".join(map(re.escape, literals)) + ")"


def _variants(char: str) -> set[str]:
    return {char.lower(), char.upper()} | {"s": {"\u017f"}, "k": {"\u212a"}}.get(char.lower(), set())


def rule_guard(line: Column, rule: Rule) -> Column:
    """Whether the line has a literal that every match of the rule contains, or at least its loose form."""
    if not rule.stems:
        return line.rlike(rule.loose)
    if rule.folds_case:
        return line.rlike(_folded(rule.stems))
    return _any(line.contains(s) for s in rule.stems)


def signature_guard(line: Column, rules: list[Rule]) -> Column:
    """Whether any rule's guard holds, with the literals of all rules tested together."""
    plain = "\n".join(sorted({s for r in rules if not r.folds_case for s in r.stems}))
    folded = [s for r in rules if r.folds_case for s in r.stems]
    tests = [line.rlike(r.loose) for r in rules if not r.stems]
    if plain:
        tests.append(F.exists(F.split(F.lit(plain), "\n"), lambda s: line.contains(s)))
    return _any(tests + ([line.rlike(_folded(folded))] if folded else []))
