import random
import re
from collections import Counter

from benchlens.llm import license_scan as L

SF = "/root/testdata/sf0.01"


def one(text):
    return [(m["license"], m["missing"], m["extra"]) for a, b in L.blocks(text) for m in L.match(text[a:b])]


def test_exact_and_changed_wording():
    assert one("Prose here.\nReleased under the MIT License.\nMore prose") == [("MIT", [], [])]
    assert one("x Licensed under CC BY-NC 4.0. y") == [("CC-BY-NC-4.0", [], [])]
    assert one("Licensed under CC BY 4.0.") == [("CC-BY-4.0", [], [])]
    assert one("This work is licensed under the GNU General Public License, version 3.") == [("GPL-3.0", [], [])]
    assert one("This work is licensed under the GNU General Public License, version 2.") == [("GPL-2.0", [], [])]
    assert one(L.NOTICES["Apache-2.0"].upper().replace(". ", ".\n"))[0] == ("Apache-2.0", [], [])
    changed = L.NOTICES["MIT"].replace("hereby granted", "granted").replace("substantial", "large")
    assert one(changed) == [("MIT", ["hereby", "substantial"], ["large"])]


def test_nothing_to_find():
    for text in ("", "A license to thrill", "No permission was given to enter the garden.", "licensed", "word " * 50000 + "license"):
        assert one(text) == []


def test_two_statements():
    got = one("Released under the MIT License. Licensed under the Apache License, Version 2.0.")
    assert sorted(g[0] for g in got) == ["Apache-2.0", "MIT"]


def test_planted_lines_against_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    want = sorted((r.doc_id, k) for r in docs.collect() for line, k in lines.items() for _ in re.findall(re.escape(line), r.text or ""))
    got = L.scan(docs).collect()
    assert sorted((r.doc_id, r.license) for r in got) == want and want
    assert all(r.exact and 0 < r.saving < 1 for r in got)


def test_edges(spark):
    rows = [(1, None, "c"), (2, "", "c"), (None, "Released under the MIT License.", "c"), (3, "Released under the MIT License.", "c"), (3, "Released under the MIT License.", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    assert sorted((r.doc_id or 0) for r in L.scan(docs).collect()) == [0, 3, 3]
    assert L.scan(docs.limit(0)).collect() == []
    own = (("Own-1", "You may read this text but never aloud"),)
    assert L.scan(spark.createDataFrame([(1, "You may read this text but never aloud. License")], "doc_id long, text string"), own).first().license == "Own-1"


def test_a_reworded_notice_does_not_hide_a_short_statement():
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this work, to use, copy, modify, publish and distribute copies of the work, provided that the above copyright notice and this permission notice appear in all copies."
    assert one(notice) == []
    assert one(f"{notice} Released under the MIT License.") == [("MIT", [], [])]
    assert one(f"Released under the MIT License. {notice}") == [("MIT", [], [])]


def test_statements_inside_prose():
    assert one("Our weather station firmware, maintained since 2014 by volunteers, is released under the MIT License.") == [("MIT", [], [])]
    assert one("Our weather station firmware, kept by volunteers, is released under\nthe MIT License and runs on small boards.") == [("MIT", [], [])]
    assert one("Volunteers keep it alive. Nobody is paid.\n\nThe mast was raised before dawn, a license was not needed.") == []
    for license, names in L.NAMES.items():
        for name in names:
            got = one(f"The weather station firmware, kept alive since 2014 by volunteers, is released under {name} and runs well.")
            assert [g[0] for g in got] == [license], name


def test_another_name_is_another_license():
    for text in (
        "This work is licensed under CC BY-NC-ND 4.0.",
        "This software is licensed under the Eclipse Public License, version 2.0.",
        "This work is licensed under the GNU Affero General Public License, version 2.",
        "This work is licensed under the GNU General Public License, version 4.",
        "This work is licensed under CC BY ND SA 4.0.",
    ):
        assert one(text) == [], text


def every(block, extra=()):
    """What a block states, from all templates in turn: no ranking, no compression."""
    parts, out = [L.words_of(block)], []
    while parts:
        part = parts.pop(0)
        best = None
        for k, (license, words) in enumerate(L.templates(extra)):
            if len(part) < 2 or L.differences(part, words)[0] < L.LEAST_SAME * len(words):
                continue
            at = L._place(part, words)
            same, missing, more = L.differences(part[at[0] : at[1]], words)
            named = L._names(extra)[k]
            if same < L.LEAST_SAME * len(words) or len(more) > L.MOST_EXTRA * len(words):
                continue
            if named and (named - (Counter(words) - Counter(missing)).keys() or L.MODIFYING & set(more)):
                continue
            key = (len(missing) + len(more), -len(words))
            if best is None or key < best[0]:
                best = (key, license, at, missing, more)
        if best:
            out.append((best[1], best[3], best[4]))
            parts += [part[: best[2][0]], part[best[2][1] :]]
    return sorted(out, key=str)


def test_joined_statements_against_all_templates():
    """Every pair of licenses, and seeded joins of three own templates, as if there were no ranking."""
    from itertools import combinations

    names = [(k, n[0]) for k, n in L.NAMES.items()]
    for (k, a), (j, b) in combinations(names, 2):
        got = one(f"Released under {a}. Licensed under {b}.")
        assert sorted(g[0] for g in got) == sorted((k, j)), (a, b)
    rng = random.Random(8)
    texts = [p.format(n) for ns in L.NAMES.values() for n in ns for p in L.PHRASES] + list(L.NOTICES.values())
    for _ in range(60):
        block = " ".join(rng.choice(texts) for _ in range(3))
        assert sorted([(m["license"], m["missing"], m["extra"]) for m in L.match(block)], key=str) == every(block), block


def test_own_templates_without_a_telling_word(spark):
    own = (("Own-1", "You may read this text but never aloud"), ("Own-2", "Sing it at dawn only, and at dusk twice"))
    docs = spark.createDataFrame([(1, "Prose that goes on. You may read this text but never aloud. More prose."), (2, "You may read it."), (3, "Sing it at dawn only, and at dusk twice")], "doc_id long, text string")
    assert sorted((r.doc_id, r.license) for r in L.scan(docs, own).collect()) == [(1, "Own-1"), (3, "Own-2")]
    assert L.scan(docs).collect() == []
