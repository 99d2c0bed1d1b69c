import textwrap

from keysweep.llm.licenses import ALL_KNOWN, GATE, KNOWN, known_digests, licenses


def test_whole_texts_and_lines(spark, make_docs):
    mit = next(t for n, t in KNOWN if n == "MIT" and len(t) > 500)
    docs = make_docs([
        (1, mit), (2, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(",", " ;")), (3, mit + " And more."),
        (4, "x\nreleased UNDER the MIT licence\nLicensed under the Apache License; Version 2.0."),
        (5, None), (6, ""), (7, "Copyright 2020 A\nCopyright 2021 B"), (8, "Released under the MIT License."),
        (8, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0."), (9, "word " * 200_000)])
    got = sorted(((r["id"], r["line"], r["license"]) for r in licenses(docs, known_digests(spark)).collect()), key=str)
    assert got == sorted([
        (1, 0, "MIT"), (2, 0, "MIT"), (4, 2, "MIT"), (4, 3, "Apache-2.0"), (8, 0, "MIT"), (8, 1, "MIT"), (8, 0, "MIT"), (8, 1, "MIT"),
        (None, 0, "CC-BY-NC-4.0"), (None, 1, "CC-BY-NC-4.0")], key=str)


def test_gate_is_implied_and_empty_tables(spark, make_docs):
    known = known_digests(spark)
    docs = make_docs([(i, t) for i, (_, t) in enumerate(KNOWN)])
    rows = lambda gate: sorted(tuple(r) for r in licenses(docs, known, gate=gate).collect())
    assert rows(GATE) == rows(None)
    assert {r[0] for r in rows(GATE) if r[1] == 0} == set(range(len(KNOWN)))
    assert licenses(make_docs([]), known).collect() == [] == licenses(docs, known.limit(0)).collect()


def test_wrapped_texts(spark, make_docs):
    """Entire texts wrapped at any width, with copyright lines, indented or in comments."""
    whole = [(name, text) for name, text in ALL_KNOWN if len(text) > 500]
    assert {name for name, _ in whole} >= {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "Unlicense", "Zlib", "Apache-2.0"}
    rows, want = [], []
    for width in (40, 60, 66, 70, 72, 76, 78, 79, 80, 100):
        for name, text in whole:
            parts = ["\n".join(textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)) for p in text.split("\n\n")]
            lines = "\n\n".join([*parts[:1], "Copyright (c) 2001-2020, Jane Doe <j@example.com>\nAll rights reserved.", *parts[1:]] if width % 20 else parts)
            for made in (lines, textwrap.indent(lines, " * ", lambda line: True)) if not width % 20 else (lines,):
                want.append((len(rows), name))
                rows.append((len(rows), made))
    found = licenses(make_docs(rows), known_digests(spark)).where("line = 0").collect()
    assert sorted((r["id"], r["license"]) for r in found) == want


def test_prose_is_kept_and_holders_go(spark, make_docs):
    body = next(text for name, text in KNOWN if name == "ISC" and len(text) > 500)
    rows = [(1, "Copyright Jane Doe\n" + body), (2, "Copyright: 2020, J\n" + body), (3, "copyright notice and more\n" + body), (4, "(c) 1999\n" + body)]
    found = licenses(make_docs(rows), known_digests(spark)).where("line = 0").collect()
    assert sorted(r["id"] for r in found) == [1, 2, 4]
