"""Places where an operator once did less than the whole job."""

import base64
import math
import random
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

LONG = " ".join(["Words, and more of them."] * 80)


@pytest.mark.parametrize(("page", "text"), [
    (f"<div><h1>Title</h1><p>Short intro, yes.</p><p>{LONG}</p></div>", f"Title\nShort intro, yes.\n{LONG}"),
    (f"<body><div><p>Lead, short.</p></div><div id=c><h2>Head</h2><p>{LONG}</p></div></body>", f"Lead, short.\nHead\n{LONG}"),
    (f"<body><article><p>{LONG}</p></article><article><h2>Second</h2><p>Two, and so.</p></article></body>", f"{LONG}\nSecond\nTwo, and so."),
    (f"<body><div><h2>Head</h2><p>{LONG}</p></div></body>", f"Head\n{LONG}"),
])
def test_extract_keeps_every_content_block(page, text):
    from lexmill.llm.html_text import extract

    assert extract(page) == text


def test_near_copies_keep_one_of_each_component(spark):
    from lexmill.llm.jaccard_join import drop_near_copies

    rng = random.Random(12)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(60))
    a, b, c, d, e, f, g = (text() for _ in range(7))
    near = lambda t: t + " more"
    rows = [
        (1, a), (2, near(a)), (2, b), (3, near(b)),  # id 2: a copy of 1, and the first of another component
        (None, c), (None, d), (None, near(d)), (None, e), (4, near(e)),  # no id: c and one d stay, e goes for 4
        (5, f), (5, near(f)), (5, g), (5, g),  # one id, one component: one stays
        (None, None), (None, ""), (None, " \t"), (6, ""), (6, ""), (6, None),  # without words: all stay
    ]
    table = lambda rows: spark.createDataFrame([(i, t, "en", f"s{n % 2}", None if t is None else len(t)) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = table(rows)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = sorted(map(repr, kept.collect()))
    pairs = [(r["doc_id"], r["text"]) for r in kept.collect() if (r["text"] or "").strip()]
    assert len(got) == 7 + 6 and {(1, a), (2, b), (None, c), (4, near(e)), (5, g)} <= set(pairs)
    assert sum((None, t) in pairs for t in (d, near(d))) == 1 and sum((5, t) in pairs for t in (f, near(f))) == 1
    whole = docs.where("text = '" + g + "'").orderBy("source").first()
    assert repr(whole) in got
    assert got == sorted(map(repr, drop_near_copies(docs.repartition(3, "n_chars", "source")).collect()))
    assert drop_near_copies(table([])).count() == 0


def test_lattice_uses_pieces_of_every_length():
    import public_tokenizers

    from lexmill.llm.lattice_lm import Lattice, load_pieces

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pieces = load_pieces(path)
    with open(path, "rb") as f:
        raw = [base64.b64decode(x.split()[0]) for x in f]
    usable = {p for p in raw if len(p.split()) == 1 and p.count(b" ") == p.startswith(b" ") and not any(c in p for c in b"\t\n\x0b\x0c\r") and p == p.lower()}
    assert {" international".encode(), " только".encode()} <= usable <= set(pieces)
    logp = np.log(np.arange(1, len(pieces) + 1) / (len(pieces) * (len(pieces) + 1) / 2))
    score = dict(zip(pieces, np.exp(logp).tolist(), strict=True))
    words = [x.encode() for x in ("internationalisation", "relationships", "только", "которыесть", "있습니다", "a", "y" * 40)] + [p.lstrip() for p in sorted(usable, key=len)[-3:]]
    for word, got in zip(words, Lattice(pieces, logp).log_probs(words).tolist(), strict=True):
        w = b" " + word
        ways = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            ways[j] = sum(ways[i] * score.get(w[i:j], 0.0) for i in range(j))
        assert math.isclose(got, math.log(ways[-1]), rel_tol=1e-9)


def test_short_items_match_exactly_between_word_borders():
    from lexmill.llm.decontamination import Matcher, nearest, pattern_masks

    m = Matcher([(1, "who wrote emma?"), (2, "art"), (3, "日本の首都はどこですか"), (4, ""), (5, "art")])
    ids = lambda text: sorted(x[0] for x in m(text))
    assert ids("he asked: who wrote emma? nobody knew") == [1]
    assert ids("who wrote emna?") == [] and ids("a party started, artful") == []
    assert ids("party of art.") == [2, 5] and ids("art") == [2, 5]
    assert ids("問題：日本の首都はどこですかと聞いた") == [3]
    text = "a party of art. so"
    assert {x[1:] for x in m(text)} == {(0, nearest(pattern_masks(" art"), 4, text)[1], 0)}


def test_classifier_fits_on_all_telling_features():
    from lexmill.llm.quality_classifier import PENALTY, fit

    rng = np.random.default_rng(13)
    y = np.arange(1000) % 2.0
    seen = rng.random((1000, 451)) < np.where(y[:, None] > 0, 0.5, 0.3)
    seen[:, 450] = (y > 0) & (np.arange(1000) < 40)
    w = fit([np.flatnonzero(r) * 7 for r in seen], y)
    v = w[np.arange(451) * 7]
    assert (v != 0).sum() > 400 and v[450] > 0
    left = y - 1 / (1 + np.exp(-(seen @ v + w[-1])))
    assert np.abs((seen.T @ left - PENALTY * v)[v != 0]).max() < 1e-4 and abs(left.sum()) < 1e-3


def test_language_of_few_documents_is_kept(spark):
    from lexmill.llm.language_id import identify

    rows = [("good house wood and field", "en")] * 20 + [("gut haus wald und feld", "de")] * 20 + [("mökki järvi metsä ja pelto", "fi")] * 2
    docs = spark.createDataFrame(rows, "text string, lang string")
    page = "<html lang='{}'><body><article><p>{}, so.</p></article></body></html>"
    pages = spark.createDataFrame([(i, f"http://h.x.{lang}/{i}", page.format(lang, text)) for i, (text, lang) in enumerate(rows)], "page_id long, url string, html string")
    assert all(r["lang"] == rows[r["page_id"]][1] for r in identify(pages, docs).collect())


def test_near_copies_drop_the_words_that_tokenizing_left_in_workers(spark, tmp_path):
    import public_tokenizers

    from lexmill.llm.jaccard_join import drop_near_copies
    from lexmill.llm.token_files import token_digests, write_tokens

    docs = spark.createDataFrame([(i, f"{i} some words of their own, {i * i} of them", "en", "s", 30) for i in range(64)], "doc_id long, text string, lang string, source string, n_chars long").repartition(16)

    def probe(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["_lexmill_worker_cache" in sys.modules])], ["kept"])

    kept = lambda: spark.range(0, 64, 1, 16).mapInArrow(probe, "kept boolean").where("kept").count()
    write_tokens(docs, f"{tmp_path}/a", public_tokenizers.path("word_bpe_49k.json"))
    assert kept() > 0
    assert drop_near_copies(docs).count() == 64
    assert kept() == 0
    write_tokens(docs, f"{tmp_path}/b", public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(token_digests(spark, f"{tmp_path}/b").collect())
    assert kept() > 0 and sorted(token_digests(spark, f"{tmp_path}/b", last=True).collect()) == want


def test_sets_of_a_batch_are_made_in_little_memory():
    from lexmill.llm._common import _shingle_sets, shingle_sets, text_bytes

    rng = random.Random(14)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(5000)]
    column = pa.array([" ".join(rng.choices(words, k=n)) for n in [3, 0, 1, 6000] * 250] + [None, " ", " ".join(words * 60)])
    whole = list(_shingle_sets(*text_bytes(column), 5))
    got = list(shingle_sets(column, 5, 1 << 12))
    assert len(got) == len(column) and all(map(np.array_equal, got, whole))
    short = column.slice(0, 1000)
    tracemalloc.start()
    for _ in shingle_sets(short, 5):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * short.nbytes
