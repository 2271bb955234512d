"""The dealt operators against brute force, and the odd cases: nulls, empties, long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n bigint, ck string, h int"


def table(spark, rows):
    """Rows (doc_id, text, lang, source), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, "x", 2) for r in rows], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("th", "er", "on", "ou", "é", "st")) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(60, 200))]
        if i % 5 == 0:
            ws[30:30] = passage.split()
        rows.append((i, " ".join(ws) + ("\n" + passage if i % 7 == 0 else ""), rng.choice(("en", "fr")), rng.choice(("s1", "s2", None))))
    for k in range(8):
        ws = rows[3][1].split(" ")
        ws[10 * k] = "changed"
        rows.append((n + k, " ".join(ws), "en", "s1"))
    rows += [(n + 20, None, None, None), (n + 21, "", "en", "s1"), (n + 22, " \t\n", "en", "s1"), (n + 23, "one two", "en", "s2"), (n + 24, "one two", "en", "s2"), (n + 25, rows[0][1], "fr", "s1"), (n + 26, "y" * 30000, "en", "s1"), (n + 27, "ab " * 5000, "en", "s2")]
    return rows


def test_jaccard_groups(spark):
    from lexmill.llm.jaccard_join import jaccard_groups

    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(table(spark, rows), 3, (9, 10)).collect()}
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard_groups(table(spark, [])).count() == 0


def test_suffix_dedup(spark):
    from lexmill.llm.suffix_dedup import remove_repeats

    rows = corpus(2, 30)
    seen = collections.Counter()
    data = {i: (t or "").encode() for i, t, *_ in rows}
    for x in data.values():
        seen.update(x[j : j + 200] for j in range(len(x) - 199))
    want = {}
    for i, x in data.items():
        gone = bytearray(len(x))
        for j in range(len(x) - 199):
            if seen[x[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        want[i] = (len(x), sum(gone), sum(g and (not j or not gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(table(spark, rows)).collect()}
    assert got == want
    assert remove_repeats(table(spark, [])).count() == 0


@pytest.mark.parametrize("k", [2, 3, 5, 300])
def test_suffix_array(k):
    from lexmill.llm.suffix_sort import permuted_prefixes, suffix_array

    rng = np.random.default_rng(k)
    for _ in range(60):
        t = np.append(rng.integers(1, k, int(rng.integers(1, 80))), 0)
        sa = suffix_array(t, k)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    raw = np.append(rng.integers(97, 99, 300), 0).astype(np.uint8)
    sa = suffix_array(raw, 256)
    plcp, b = permuted_prefixes(raw, sa, 20), bytes(raw)
    for x, y in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
        assert plcp[x] == next(m for m in range(21) if m == 20 or b[x + m : x + m + 1] != b[y + m : y + m + 1])


def test_tokens_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lexmill.llm.token_files import fresh_folder, read_tokens, token_digests, write_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*corpus(3, 20), (500, "Ünïcode <|endoftext|> İß 'S x'll 123 ٣", "en", "s1")]
    folder = fresh_folder(spark)
    write_tokens(table(spark, rows), folder, path)
    got = {r["id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_digests(spark, folder).collect()}
    raw = {r["id"]: r["tokens"] for r in read_tokens(spark, folder).collect()}
    tok, at = Tokenizer.from_file(path), 0
    for i, t, *_ in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        packed = np.array(ids, "<u4").tobytes()
        assert raw[i] == packed and got[i] == (at, len(ids), zlib.crc32(packed))
        at += len(ids)
    folder = fresh_folder(spark)
    write_tokens(table(spark, []), folder, path)
    assert token_digests(spark, folder).count() == 0


def test_code_lengths():
    from lexmill.llm.token_files import code_lengths

    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 700):
        c = (rng.pareto(0.2, n) * 5 + 1).astype(np.int64)
        lengths = code_lengths(c)
        assert lengths.max() <= 16 and (n == 1 or abs((2.0 ** -lengths.astype(float)).sum() - 1) < 1e-12)
        assert all(a <= b for a, b in zip(lengths[np.argsort(-c, kind="stable")].tolist(), lengths[np.argsort(-c, kind="stable")].tolist()[1:], strict=False)) or n > 3


def test_codes_of_more_ids_than_the_limit_has_room_for():
    from lexmill.llm.token_files import LIMIT, Codebook, code_lengths, limit_for

    rng = np.random.default_rng(5)
    n = (1 << LIMIT) + 4000
    names = np.sort(rng.choice(1 << 18, n, replace=False))
    lengths = code_lengths((rng.pareto(0.5, n) * 3 + 1).astype(np.int64), limit_for(n))
    assert lengths.max() <= limit_for(n) == LIMIT + 2
    book = Codebook(names, lengths)
    sizes = np.array([1, 700, 256, 3000])
    ids = np.concatenate([names[lengths == lengths.max()][:957], rng.choice(names, 3000)])
    assert len(ids) == sizes.sum()
    streams, marks = book.encode(ids, sizes)
    starts = np.cumsum([0, *map(len, streams)])[:-1]
    at = np.concatenate([m + 8 * s for m, s in zip(marks, starts, strict=True)])
    assert (book.decode(np.frombuffer(b"".join(streams), np.uint8), at, sizes) == ids).all()
    assert limit_for(1) == limit_for(1 << LIMIT) == LIMIT


def test_scratch_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from lexmill.llm._common import scratch_dir

    unset = SimpleNamespace(get=lambda *_: None)
    session = lambda master: SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch_dir(session(master))
    assert scratch_dir(session("local[8]")).startswith("file:")


def test_lattice():
    from lexmill.llm.lattice_lm import Lattice

    m = Lattice([b" a", b" ab", b"b", b"bc", b"c", b" abc"], np.log([0.1, 0.2, 0.1, 0.2, 0.3, 0.1]))
    assert math.isclose(math.exp(m.log_probs([b"abc"])[0]), 0.1 * 0.1 * 0.3 + 0.1 * 0.2 + 0.2 * 0.3 + 0.1)
    assert math.isclose(m.expected_counts([b"abc"])[5], 0.1 / 0.183)


def test_lm_scores(spark):
    import public_tokenizers

    from lexmill.llm.lattice_lm import lattice_scores, load_pieces

    pieces = load_pieces(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = corpus(5, 40)
    got = {r["doc_id"]: r for r in lattice_scores(table(spark, rows), pieces).collect()}
    c = collections.Counter()
    words = {i: [*(t or "").encode().lower().split(), None] for i, t, *_ in rows}
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(w)
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        r = got[i]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert lattice_scores(table(spark, []), pieces).count() == 0


def test_quality_rules(spark):
    from lexmill.llm.quality_rules import quality_keepers, quality_verdicts

    rows = corpus(6, 40)
    got = {r["doc_id"]: r for r in quality_verdicts(table(spark, rows)).collect()}
    for i, t, *_ in rows:
        t = t or ""
        w = t.encode().split()
        grams = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + d for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        r = got[i]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    kept = quality_keepers(table(spark, rows))
    assert kept.columns == table(spark, []).columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality_verdicts(table(spark, [])).count() == 0


def test_mixing(spark):
    from lexmill.llm.source_mixing import mix_sources, mixed_documents

    docs = table(spark, corpus(7, 200))
    got = mix_sources(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(docs).collect()))
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    for (size, target), part in by.items():
        assert target <= 3 * size and abs(sum(r["taken"] for r in part) - target) <= 0.05 * target + 20
    assert math.isclose(sum(t for _, t in by), sum(r["size"] for r in got), rel_tol=1e-9)
    assert mixed_documents(docs).count() == sum(r["copies"] for r in got)
    assert mix_sources(table(spark, [])).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p", "<p"),
    ("<html><body><nav><a>Menu, one.</a></nav><article><h1>Title</h1><p>First  &amp; best,\n one.<p><b>Second one, yes.<br></article><div class='comments'><p>Great read, thanks.</p></div><footer>x, y.</footer></body></html>", "Title\nFirst & best, one.\nSecond one, yes."),
    ("<body><div class=sidebar><p>Buy now, please, do.</p></div><div id=c><p>Long text, with commas, and so on.</p><p>More of it, here.</p></div><script>var a='<p>no, no.</p>'</script><!-- <p>gone, too.</p> --></body>", "Long text, with commas, and so on.\nMore of it, here."),
])
def test_extract(page, text):
    from lexmill.llm.html_text import extract

    assert extract(page) == text


def test_edit_matching():
    from lexmill.llm.decontamination import Matcher, nearest, pattern_masks

    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (c != d)))
            row = new
        return min(row)

    rng = random.Random(8)
    for _ in range(200):
        p = "".join(rng.choice("ab") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))
        assert nearest(pattern_masks(p), len(p), t)[0] == min(distance(p, t), len(p))
    item = "".join(rng.choice("abcdefgh ") for _ in range(200)).strip()
    m = Matcher([(1, item), (2, "short")])
    for edits in range(14):
        x = list(item)
        for at in rng.sample(range(len(x)), edits):
            x[at] = "z"
        found = m("y" * 50 + "".join(x) + "y" * 50)
        assert (found and found[0][:2] == (1, edits)) if edits <= len(item) // 16 - 1 else not found


def test_leaks(spark):
    from lexmill.llm.decontamination import clean_documents, leaks

    rows = corpus(9, 10)
    item = rows[4][1][40:300]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(table(spark, rows), bench).collect()}
    assert (4, 1) in got and {i for i, _ in got} == {i for i, t, *_ in rows if item in (t or "")}
    assert clean_documents(table(spark, rows), bench).count() == len(rows) - len(got)
    assert leaks(table(spark, []), bench).count() == 0 and leaks(table(spark, rows), bench.limit(0)).count() == 0


def test_classifiers(spark):
    from lexmill.llm.language_id import identify
    from lexmill.llm.quality_classifier import classify

    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(("gut", "haus", "wald")) if i % 2 else rng.choice(("good", "house", "wood")) for _ in range(60)) + (" idiot" if i % 9 == 0 else ""), "de" if i % 2 else "en", f"s{i % 3}") for i in range(240)]
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(0, 200)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] >= 0.5 for r in classify(table(spark, [*rows, (900, None, None, None)]), labels).collect()}
    assert all(got[i] == (i % 9 == 0) for i in range(200, 240)) and 900 in got
    assert classify(table(spark, []), labels).count() == 0 and classify(table(spark, rows), labels.limit(0)).count() == 240
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.x.org/{i}", f"<html lang='{'de' if i % 2 else 'en'}'><body><article><p>{rows[i][1]}, so.</p></article></body></html>") for i in range(40)] + [(90, None, None), (91, "http://h1.x.org/", "")], "page_id long, url string, html string")
    out = {r["page_id"]: r["lang"] for r in identify(pages, table(spark, rows)).collect()}
    assert all(out[i] == ("de" if i % 2 else "en") for i in range(40)) and out[91] == "de" and 90 in out
    assert identify(pages.limit(0), table(spark, rows)).count() == 0 and identify(pages, table(spark, [])).count() == 42


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark, corpus(11, 60)).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    item = corpus(11, 60)[8][1][20:200]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    x, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = x.columns
        x = stage(spark, x, str(tmp_path))
        x.write.parquet(str(tmp_path / name))
        x = spark.read.parquet(str(tmp_path / name))
        left[name] = [r["doc_id"] for r in x.collect()]
        assert name == "token_output" or x.columns == columns
    assert 8 in left["near_duplicates"] and 8 not in left["decontamination"]
    assert len(left["near_duplicates"]) == len(set(left["near_duplicates"])) < len(left["quality_rules"])
    assert sorted(left["mixing"]) == sorted(left["token_output"]) and set(left["mixing"]) <= set(left["decontamination"])


def test_words_put_together_from_runs_match_whole_texts():
    from array import array

    from lexmill.llm.queries import tokenizer_path
    from lexmill.llm.token_files import _WordIds
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    plain, words, rng = Tokenizer.from_file(path), _WordIds(path), random.Random(5)
    texts = ["don't I'LL it's", "İ, ǅungla ﬁn ΟΔΟΣ. Straße;", "<|startoftext|> x<|endoftext|>, a--b (x)", "", "e\u0301cole e\u0301, 𝒳𝓎 ٣٤ ½ ª º", "漢字。 हिन्दी 한국어!"]
    letters = "aZé'.-,!?ß\u0301İΣ漢1²ªﬁ<|𝒳  "
    texts += ["".join(rng.choice(letters) for _ in range(40)) for _ in range(500)]
    want = [array("I", x.ids).tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert words.ends is not None and words([t.encode() for t in texts]) == want
    words.ends = None
    words.young.clear()
    assert words([t.encode() for t in texts]) == want
