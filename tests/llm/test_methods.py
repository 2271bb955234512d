"""The methods at work: results that change without them, paths that small inputs don't reach, limits."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest


def brute_repeats(texts, span=200):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[j : j + span] for x in raws for j in range(len(x) - span + 1))
    out = []
    for x in raws:
        gone = bytearray(len(x))
        for j in range(len(x) - span + 1):
            if seen[x[j : j + span]] > 1:
                gone[j : j + span] = b"\1" * span
        out.append((len(x), sum(gone), hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


def test_large_anchors_are_halved(spark, monkeypatch):
    """A passage that very many texts share has anchors beyond any shard: the same results through halvings."""
    from lexmill.llm import suffix_dedup as S

    rng = random.Random(21)
    word = lambda n=5: "".join(rng.choices("abcdefghij", k=n))
    passage = " ".join(word() for _ in range(45))
    texts = [" ".join(word() for _ in range(30)) + " " + passage[rng.randint(0, 20) :] + " " + " ".join(word() for _ in range(30)) for _ in range(40)] + [None, "", "x" * 900]
    monkeypatch.setattr(S, "SHARD_BYTES", 1500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in S.remove_repeats(docs).orderBy("doc_id").collect()]
    assert got == brute_repeats(texts)


def test_halves_keep_every_string():
    from lexmill.llm.suffix_dedup import SPAN, halves

    for lead, core, size in ((136, 64, 336), (10, 64, 210), (136, 64, 200), (0, 64, 200), (3, 197, 206), (0, 199, 201)):
        todo, leaves = [(0, lead, core, size)], set()
        while todo:
            at, le, co, n = todo.pop()
            if co == SPAN:
                leaves.add(at + le)
                assert le == 0 and n == SPAN
                continue
            for _, a, z, to, held in halves(le, co, n):
                assert held > co and 0 <= to and to + held <= z - a
                todo.append((at + a, to, held, z - a))
        assert leaves == set(range(max(0, lead - (SPAN - core)), min(lead, size - SPAN) + 1))


def test_windows_of_long_texts_find_the_same_anchors():
    from lexmill.llm._common import text_bytes
    from lexmill.llm.suffix_dedup import found_anchors

    import pyarrow as pa

    rng = random.Random(22)
    texts = ["".join(rng.choices("abc ", k=n)) for n in (5000, 100, 700, 12000, 0)] + [None, "ab" * 3000]
    data, off = text_bytes(pa.array(texts))

    def flat(step):
        return sorted(tuple(int(v) for v in row) for cols in found_anchors(data, off, step=step) for row in zip(*cols, strict=True))

    whole = flat(1 << 20)
    assert whole and all(flat(step) == whole for step in (300, 1000, 4096))


def test_shared_prefix_lengths():
    from lexmill.llm.suffix_dedup import _longest_shared

    rng = random.Random(23)
    parts = [bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(60)]
    anchor = np.array([rng.randint(0, 2) for _ in parts])
    same = lambda a, b: next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    want = [max((same(p, q) for j, q in enumerate(parts) if j != i and anchor[i] == anchor[j]), default=0) for i, p in enumerate(parts)]
    assert _longest_shared(anchor, parts).tolist() == want


LONG = "The long text, with commas, goes on here. " * 6
PLAIN = [
    (f"<html><body><div><a>Home</a> <a>News</a> <a>About us</a></div><h1>Title here</h1><p>{LONG}</p><ul><li>one</li><li>two</li></ul><p>{LONG}</p><div>Copyright 2020 Foo</div></body></html>", f"Title here\n{LONG.strip()}\none\ntwo\n{LONG.strip()}"),
    (f"<body><table><tr><td><a>x</a></td><td><div><h2>Head</h2>{LONG}<br><br>{LONG}</div></td></tr><tr><td>foot</td></tr></table>", f"Head\n{LONG}{LONG.strip()}"),
]


@pytest.mark.parametrize(("page", "text"), PLAIN)
def test_ratios_find_text_without_marks(page, text, monkeypatch):
    """No article element, no class: furniture goes by the ratios alone, and stays when they are switched off."""
    from lexmill.llm import html_text as H

    words = collections.Counter(text.split())

    def score(got):
        both = sum((collections.Counter(got.split()) & words).values())
        return 2 * both / (len(got.split()) + len(text.split()))

    assert " ".join(H.extract(page).split()) == " ".join(text.split())
    on = score(H.extract(page))
    monkeypatch.setattr(H, "content_paths", lambda nodes, texts: {x.path for x in nodes})
    assert score(H.extract(page)) < on == 1.0


@pytest.mark.parametrize("page", ["<div>" * 12000 + "x", "<a b" * 8000, "<span>" * 20000 + "<p>a</p>" * 5000, "<b><p>" * 20000, "</p>" * 50000, '<a "x>' * 8000])
def test_hostile_markup_takes_linear_time(page):
    import time

    from lexmill.llm.html_text import extract

    began = time.process_time()
    extract(page)
    assert time.process_time() - began < 5


def test_extract_pages_frame(spark):
    from lexmill.llm.html_text import extract_pages

    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, None, "<article><p>One, two.</p></article>", "clash", 3), (1, None, "<article><p>One, two.</p></article>", "clash", 3), (None, "u", None, None, None)]
    got = sorted(map(repr, (tuple(r) for r in extract_pages(spark.createDataFrame(rows, schema)).collect())))
    assert got == sorted(map(repr, [(1, None, "One, two.", 9)] * 2 + [(None, "u", "", 0)]))
    assert extract_pages(spark.createDataFrame([], schema)).count() == 0


def test_thresholds_follow_their_group(spark):
    """Two sources alike but for the share of symbols that is usual in them: the same document passes in one only."""
    from lexmill.llm.quality_rules import GAMMA, quality_verdicts

    rng = random.Random(24)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    plain = lambda: " ".join(word() for _ in range(60))
    some = lambda: " ".join(word() + ("#" if rng.random() < 0.3 else "") for _ in range(60))
    rows = [(i, plain(), "en", "prose") for i in range(900)] + [(1000 + i, some(), "en", "code") for i in range(300)] + [(5000, some(), "en", "prose"), (5001, None, None, None), (5002, "", "en", "prose")]
    got = {r["doc_id"]: r for r in quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[5000]["kept"] and sum(got[1000 + i]["kept"] for i in range(300)) >= 290 and all(got[i]["kept"] for i in range(900))
    assert got[0]["symbols_most"] < got[1000]["symbols_most"] and not got[5001]["kept"] and not got[5002]["kept"] and GAMMA > 1


def test_scores_are_probabilities(spark):
    """One-word vocabulary of every word of up to two letters over two letters, and the end: the classes' word probabilities add up."""
    from lexmill.llm.lattice_lm import lattice_scores

    pieces = [b" a", b" b", b"a", b"b"]
    train = [(1, "a b a a b", "x"), (2, "a a a", "x"), (3, "b b b b a", "y"), (4, "b", "y")]
    probes = ["", *("".join(p) for n in (1, 2, 3) for p in __import__("itertools").product("ab", repeat=n))]
    rows = train + [(100 + i, w, None) for i, w in enumerate(probes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in lattice_scores(docs, pieces, held_out="doc_id >= 100").collect()}
    p = {w: 10 ** got[100 + i]["score"] for i, w in enumerate(probes)}
    # the empty text is the end alone; one word and the end for the others
    assert 0 < p[""] < 1 and sum(p.values()) < 1
    assert all(got[100 + i]["held_out"] and got[100 + i]["n_tokens"] == (2 if w else 1) for i, w in enumerate(probes))
    assert p["a"] > p["ab"] > p["aba"] > 0 and math.isclose(p["ab"] * 1.0, p["ab"])
    assert got[1]["score"] > got[1]["base_score"] - 5


def test_size_classes_lose_no_pair(spark):
    """Pairs at the edge of the similarity, of all sizes around the borders of classes."""
    from lexmill.llm.jaccard_join import jaccard_groups

    rng = random.Random(25)
    rows, want = [], {}
    for n in (9, 18, 27, 36, 45, 63, 90, 117, 180):
        base = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(2 + -(-n * 10 // 9))]
        small, large = base[: n + 2], base  # n and ceil(n / 0.9) shingles
        i = len(rows)
        rows += [(i, " ".join(small)), (i + 1, " ".join(large))]
        sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in (small, large)]
        linked = 100 * len(sets[0] & sets[1]) >= 90 * len(sets[0] | sets[1])
        want |= {i: i, i + 1: i if linked else i + 1}
    assert sum(v != k for k, v in want.items()) >= 5
    got = {r["doc_id"]: r["component_id"] for r in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, (9, 10)).collect()}
    assert got == want
