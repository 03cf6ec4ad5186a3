"""Text operators on awkward rows, against plain versions and against public libraries."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from vacanta.llm import langid, licences, linededup, maintext, packing, pieces, quality, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, kept_text string, lang_pred string"
SF = "/root/testdata/sf0.01"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["stone", "river", "grey", "walks", "over", "many", "bright", "fields"]) for _ in range(n))


def awkward_rows():
    rng = random.Random(3)
    whole = "\n".join(sentence(rng, 12) for _ in range(9))
    near = whole.replace("river", "rivers", 1)
    rows = [
        (1, whole), (2, None), (3, ""), (4, " \n\t "), (5, "x"), (6, whole), (6, whole), (7, near),
        (None, "no id but a text"), (None, "no id but a text"), (8, sentence(rng, 60_000)),
        (9, "word " * 3), (10, "é" * 50 + " ü\n\n\nß"), (11, "%%% !!! 123"), (12, "a\x00b <|endoftext|> c"),
    ]
    return [(i, t, "en", "s", len(t or ""), "old", "old", "old") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language_rows(spark, docs, nothing):
    model = langid.train(spark.createDataFrame([("ab ab ab", "x"), ("cd cd cd", "y"), (None, "x"), ("q", None)], "text string, lang string"))
    assert model.languages == ["x", "y"]
    got = langid.identify(docs, model)
    assert got.columns == [c for c in docs.columns if c != "lang_pred"] + ["lang_pred", "lang_score"]
    rows = got.collect()
    assert len(rows) == docs.count()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {2, 3, 4, 11} and all(0 <= r.lang_score <= 1 for r in rows)
    assert langid.identify(nothing, model).count() == 0
    untrained = langid.train(nothing)
    assert {r.lang_pred for r in langid.identify(docs, untrained).collect()} == {"und"}


def test_language_counts_do_not_depend_on_pieces(monkeypatch):
    text = "".join(random.Random(1).choice("abcdeé ") for _ in range(5000))
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "PIECE", 700)
    assert (langid.ngram_counts(text) == whole).all()
    assert whole.sum() == sum(len(text) - n + 1 for n in langid.ORDERS)


def test_language_held_out_accuracy(spark):
    from vacanta.llm.queries import op6_language

    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op6_language(spark, SF).where("held_out").join(truth, "doc_id").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.98


def test_quality_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 1), (7, 0), (None, 1), (9, None)], "doc_id bigint, quality int")
    weights = quality.train(docs, labels)
    rows = quality.score(docs, weights).collect()
    assert len(rows) == docs.count() and all(0 <= r.quality_score <= 1 for r in rows)
    same = {r.quality_score for r in rows if r.doc_id in (2, 3, 4)}
    assert len(same) == 1  # no feature: the bias alone
    flat = quality.train(docs, labels.where("false"))
    assert {r.quality_score for r in quality.score(docs, flat).collect()} == {0.5}
    assert quality.score(nothing, weights).count() == 0


def test_quality_learner_separates():
    learner = quality.FtrlLearner()
    good, bad = quality.features("calm words in order"), quality.features("!!! BUY !!! BUY !!!")
    for _ in range(50):
        learner.learn(*good, 1.0)
        learner.learn(*bad, 0.0)
    w = learner.weights()
    p = [quality._sigmoid(w[b] @ v + w[quality.BUCKETS]) for b, v in (good, bad)]
    assert p[0] > 0.9 and p[1] < 0.1


def test_quality_held_out(spark):
    from vacanta.llm.queries import op1_quality

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op1_quality(spark, SF).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return 0
    shingles = [" ".join(found[k : k + 3]) for k in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, near):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, a in enumerate(points):
        for b in points[:k]:
            if near(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in points}


def test_simhash_rows(docs, nothing):
    rows = simhash.near_duplicates(docs).collect()
    texts = {r[0]: r[1] for r in awkward_rows()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r.fingerprint & (2**64 - 1) == plain_fingerprint(texts[r.doc_id])
    roots = plain_components(sorted({r.fingerprint for r in rows}), lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3)
    ids = {}
    for r in rows:
        if r.doc_id is not None:
            ids.setdefault(roots[r.fingerprint], []).append(r.doc_id)
    for r in rows:
        assert r.component_id == min(ids.get(roots[r.fingerprint], [None]))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()).count("None") == 1
    assert kept.count() == len(set(roots.values()))
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_simhash_words_end_at_ascii_spaces_only(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 50)
    text = ("long" * 30 + "\u00a0" + "word" * 30 + "\u2003x ") * 4 + "\x1cends\x0bhere\x85now " * 9
    assert simhash.simhash(text) & (2**64 - 1) == plain_fingerprint(text)


def test_language_letters():
    model = langid.LanguageModel(["x"], np.zeros(1), np.zeros((langid.BUCKETS, 1)))
    for text in ("½ ²", "Ⅷ", "①", "12 %", "_", None, ""):
        assert langid.predict(model, text) == ("und", 0.0)
    for text in ("é", "1a", "語"):
        assert langid.predict(model, text)[0] == "x"


def test_simhash_pieces(monkeypatch):
    text = sentence(random.Random(5), 3000)
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "PIECE", 500)
    assert simhash.simhash(text) == whole


def test_trees_find_every_link(spark):
    rng = np.random.default_rng(2)
    points = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64) for _ in range(3)]
    close = points[:600] ^ flips[0] ^ flips[1] ^ np.where(rng.random(600) < 0.5, flips[2], 0).astype(np.uint64)
    dense = points[0] ^ np.arange(64, dtype=np.uint64)
    points = np.unique(np.concatenate([points, close, dense]))
    frame = spark.createDataFrame(pd.DataFrame({"fingerprint": points.view(np.int64)}))
    from vacanta.llm.components import components

    got = {r.node: r.root for r in components(simhash.links(frame, leaf=64)).collect()}
    in_blocks = {r.node: r.root for r in components(simhash.links(frame, leaf=64, block=40)).collect()}
    assert in_blocks == got
    signed = sorted(points.view(np.int64).tolist())
    want = {p: p for p in signed}
    near = np.bitwise_count(points[:, None] ^ points[None]) <= 3
    pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)))]
    names = points.view(np.int64).tolist()

    def find(p):
        while want[p] != p:
            p = want[p]
        return p

    for a, b in pairs:
        x, y = find(names[a]), find(names[b])
        want[max(x, y)] = min(x, y)
    assert {p: got.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_language_stage_drops_what_was_not_learned(spark):
    import base64

    import corpus_pipeline

    read = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(3)
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem.",
        base64.b64encode(rng.randbytes(300)).decode(),
        "83749 283 x 9387 4928 3749 28374 9283 749283",
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)),
    ]
    clean = ["All human beings are born free and equal in dignity and rights.", "Von.", "The same."]
    rows = [(-k - 1, t, None, "x", len(t)) for k, t in enumerate(foreign + clean)]
    docs = read.unionByName(spark.createDataFrame(rows, read.schema))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in read.collect()} | {-k - 1 for k in range(len(foreign), len(rows))}


def test_near_copy_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline

    rng = random.Random(8)
    texts = []
    for _ in range(20):  # exact copies, and copies with one changed word in many
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(900)]
        texts += [" ".join(words)] * 2
        words[rng.randrange(900)] = "changed"
        texts.append(" ".join(words))
    texts += ["one two", "one two", "ONE  two", "three", "", None, " "]
    prints = [plain_fingerprint(t) for t in texts]
    roots = plain_components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for k, f in enumerate(prints):
        first.setdefault(roots[f], k)
    rows = spark.createDataFrame([(k, t, "a", "b") for k, t in enumerate(texts)], "doc_id bigint, text string, _text_hash string, _kept_doc_id string")
    got = corpus_pipeline.one_of_each(spark, rows, SF)
    assert got.columns == rows.columns and {r.doc_id for r in got.collect()} == set(first.values())
    assert len(first) < 50


def test_line_dedup_rows(spark, docs, nothing):
    rows = linededup.remove_repeated(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].kept_text is None and by_id[3].kept_text == ""
    assert by_id[1].kept_text == by_id[1].text and by_id[1].lines_removed == 0
    assert by_id[6].lines_removed > 0 and len(by_id[6].kept_text) < len(by_id[6].text)
    assert by_id[10].kept_text == by_id[10].text
    assert linededup.remove_repeated(nothing).count() == 0


def test_line_dedup_survives_shifted_lines(spark):
    rng = random.Random(9)
    passage = [sentence(rng, 9) + f" {k}" for k in range(40)]
    rows = [(1, "\n".join(passage)), (2, "\n".join(["an own first line", *passage[3:], "an own last line"]))]
    got = linededup.remove_repeated(spark.createDataFrame(rows, "doc_id bigint, text string"))
    second = got.where("doc_id = 2").first()
    assert second.lines_removed > 25
    assert second.kept_text.startswith("an own first line") and second.kept_text.endswith("an own last line")


def test_line_runs_go_to_their_ends(spark):
    rng = random.Random(5)
    long = " ".join(f"w{k}" for k in range(51))
    passages = {n: [f"{long} {n} {k}" if n == 1 else sentence(rng, 9) + f" {n} {k}" for k in range(n)] for n in range(1, 7)}
    rows, want = [], {}
    for n, passage in passages.items():
        for copy in range(3):
            before, after = (f"own {side} {n} {copy}" for side in ("before", "after"))
            gap = [" "] if copy == 2 else []  # a blank line inside a copy
            text = [before, *passage[:1], *gap, *passage[1:], after]
            doc = 10 * n + copy
            rows.append((doc, "\n".join(text)))
            kept = text if not copy else [before, *(gap if n == 1 else []), after]
            want[doc] = ("\n".join(kept), len(text) - len(kept))
    rows += [(100, "a short line"), (101, "a short line"), (102, "x\nx\nx\nx"), (103, None), (104, ""), (None, "no id")]
    want |= {100: ("a short line", 0), 101: ("a short line", 0), 102: ("x", 3), 103: (None, 0), 104: ("", 0), None: ("no id", 0)}
    got = linededup.remove_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.kept_text, r.lines_removed) for r in got} == want


def test_line_runs_against_a_plain_version(spark):
    rng = random.Random(6)
    rows = [(d, "\n".join(rng.choice(["a", "b", "c", "d", "e", "", long_line]) for _ in range(rng.randint(1, 6))))
            for d, long_line in enumerate([" ".join("w" * 60)] * 60)]
    seen, want = set(), {}
    for d, text in rows:
        lines = text.split("\n")
        full = [k for k, line in enumerate(lines) if line.strip()]
        gone = set()
        windows = [(i, j) for i, j in zip(full, full[1:])] + [(i, i) for i in full if len(lines[i].split()) > 50]
        for i, j in sorted(windows):
            key = (lines[i], lines[j]) if i < j else (lines[i],)
            gone |= set(range(i, j + 1)) if key in seen else set()
            seen.add(key)
        want[d] = ("\n".join(line for k, line in enumerate(lines) if k not in gone), len(gone))
    got = linededup.remove_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.kept_text, r.lines_removed) for r in got} == want


def test_packing_rows(spark, docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, path).toPandas()
    check_packing(awkward_rows(), got, path)
    assert packing.pack(nothing, path).count() == 0


def check_packing(rows, got, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ids = {}
    for row in rows:
        ids[row[0]] = np.array(tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [1], dtype="<u4")
    for r in got.itertuples():
        own = ids[None if pd.isna(r.doc_id) else r.doc_id]
        assert len(own) == r.doc_tokens and r.length > 0
        assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert got.length.sum() == sum(len(ids[row[0]]) for row in rows)
    ordered = got.sort_values(["sequence_id", "offset"])
    before = ordered.groupby("sequence_id").length.cumsum() - ordered.length
    assert (before == ordered.offset).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= packing.WINDOW


def test_packing_pads_little(spark):
    from vacanta.llm.queries import op4_packing

    filled = op4_packing(spark, SF).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas().n
    padding = sum(packing.WINDOW - n for n in filled if n & (n - 1))
    assert padding < 0.01 * filled.sum()


def test_least_squares_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12) * 10
        x = packing.least_squares(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and gradient.max() < 1e-3 and np.abs(gradient[x > 0]).max(initial=0) < 1e-3


def test_combinations_fill_the_window():
    found = packing.combinations(12)
    assert len(set(found)) == len(found) == 1 + 6 + 12  # partitions of 12 into 1, 2 and 3 parts
    assert all(sum(c) == 12 and list(c) == sorted(c) for c in found)
    assert packing.plan({256: 3, 100: 2, 156: 2}) == [((100, 156), 2), ((256,), 3)]


@pytest.mark.parametrize(
    "text",
    ["", "  a  b", "a\n\nb", "a\n\n\nb c", "x \n y", "tab\tz", "it's we'll o'clock.", "% && ..  ", "<|endoftext|> a", "a\xa0b", "| a |", "日本 語.", " trail "],
)
def test_word_encoder(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.WordEncoder(path).encode(text).tolist() == [*want, packing.END_ID]


def test_pieces_match_the_library(spark, docs, nothing):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    rows = pieces.decode(pieces.encode(docs, path), path).collect()
    for r in rows:
        assert r.piece_ids == library.encode(r.text or "")
        assert r.decoded_text == (r.text or "")
    assert pieces.encode(nothing, path).count() == 0
    model = pieces.PieceModel(path)
    for text in ["ﬁ № ①", " ", "<s>a</s>", "日本語 テスト", "   lead", "aaaa" * 9, "🙂 ok", "\r\n"]:
        assert model.encode(text).tolist() == library.encode(text)


def test_unigram_viterbi_is_optimal():
    rng = random.Random(4)
    scores = {p: -rng.random() * 5 - 0.1 for p in ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "aa"]}
    model = pieces.PieceModel.of({p: (k + 1, s) for k, (p, s) in enumerate(scores.items())})
    names = {k + 1: p for k, p in enumerate(scores)}

    def best(text):
        if not text:
            return 0.0
        return max(scores[text[:k]] + best(text[k:]) for k in range(1, 4) if text[:k] in scores)

    for _ in range(40):
        text = "".join(rng.choice("abc") for _ in range(9))
        found = [names[k] for k in model.viterbi(text)]
        assert "".join(found) == text and abs(sum(scores[p] for p in found) - best(text)) < 1e-9
    assert model.viterbi("axb") == [1, 0, 2]  # an uncovered character is the unknown id


PAGES = [
    (1, "http://h/1", "<nav><a>Menu</a></nav><article><h1>T &amp; U</h1><p>one <b>bold</b>x<p class=notice>buy<p>two</article><footer>f"),
    (2, "http://h/2", None),
    (3, "http://h/3", ""),
    (4, None, "<main><script>var t='</p>';</script><p>a<br>b</p><aside>no</aside><table><tr><td>1</td><td>2</td></tr></table></main>"),
    (5, "x", "<body><header>Site</header><div class='cookie-banner'>ok</div><p>only  this\n</p><section id=comments><article>me too</article></section>"),
    (None, "http://h/6", "<p>plain &lt;text&gt;"),
    (5, "x", "<p>twice"),
]


def test_main_text(spark):
    frame = spark.createDataFrame([(*row, "old") for row in PAGES], "page_id bigint, url string, html string, text string")
    rows = [(r.page_id, r.text) for r in maintext.main_text(frame).collect()]
    want = [(1, "T & U\none boldx\ntwo"), (2, ""), (3, ""), (4, "a b\n1 2"), (5, "only this"), (None, "plain <text>"), (5, "twice")]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert maintext.main_text(frame.where("false")).count() == 0


def test_main_text_counts_pages_with_equal_menus(spark):
    menu = " ".join(f"item{k}" for k in range(12))
    def page(k):
        return (k, f"http://h/{k}", f"<div>{menu}</div><article>text {k}</article>")
    rows = [page(k) for k in range(100)] + [(100, "http://h/100", f"<div>{menu}</div><div>own words</div>")]
    # on another host the same page twice over: copies are no evidence
    rows += [(200 + k, "http://g/", page(0)[2]) for k in range(5)] + [(300, "http://g/300", rows[100][2])]
    got = maintext.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    texts = {r.page_id: r.text for r in got.collect()}
    assert len(texts) == len(rows) and texts[7] == "text 7"
    assert texts[100] == "own words" and texts[300] == f"{menu}\nown words"


def test_main_text_takes_the_whole_host_as_evidence(spark, monkeypatch):
    monkeypatch.setattr(maintext, "SHARD", 4)
    rows, want = [], {}
    for k in range(60):  # every notice is on 3 pages, in any of 15 shards; every pair on 2
        notice = " ".join(f"n{k // 3}x{j}" for j in range(10))
        pair = " ".join(f"p{k // 2}x{j}" for j in range(10))
        rows.append((k, f"http://h/{k}", f"<p>own{k}</p><p>{notice}</p><p>{pair}</p>"))
        want[k] = f"own{k}\n{pair}"
    got = maintext.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == want


def test_main_text_holds_articles_against_the_host(spark):
    notice = " ".join(f"notice{j}" for j in range(10))
    motto = " ".join(f"motto{j}" for j in range(10))
    rows, want = [], {}
    for k in range(6):  # the notice is in articles and repeated outside, the motto is in articles alone
        outside = "" if k < 3 else f"<footer>{k}<p>{notice}</p></footer>"
        text = f"own {k}\n{motto}" + (f"\n{notice} {k}\n{notice}" if k < 3 else "")
        rows.append((k, f"http://h/{k}", f"<article><p>{text.replace(chr(10), '<p>')}</article>{outside}"))
        want[k] = text, 20 if k < 3 else 0
    rows.append((0, "http://h/again", rows[0][2]))
    # what two pages repeat is no evidence, nor is another host
    rows += [(10 + k, f"http://g/{k}", f"<article><p>{notice}</p></article><footer>{k}<p>{notice}</p></footer>") for k in range(2)]
    want |= {10 + k: (notice, 0) for k in range(2)}
    got = maintext.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(rows)
    assert {r.page_id: (r.text, r.n_repeated) for r in got} == want


def test_main_text_drops_what_a_host_repeats(spark):
    rng = random.Random(2)
    menu = " ".join(f"item{k}" for k in range(12))
    own = [sentence(rng, 30) + f" {k}" for k in range(6)]
    rows = [(k, f"http://h/{k}", f"<div>{menu}</div><div>{own[k]}</div><div>{menu} tail{k}</div>") for k in range(6)]
    got = maintext.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == {k: f"{own[k]}\ntail{k}" for k in range(6)}


@pytest.mark.parametrize(
    "html,want",
    [
        ("<article class='post comments-open'><p>a</p><article class='comment'>no</article></article>", ["a"]),
        ("<main class='with-sidebar'><div class='sidebar-layout'>a</div><div class='main-sidebar'>no</div></main>", ["a"]),
        ("<article><header><h1>T</h1></header><p>a<div id=shareButtons>no</div><p hidden>no</p></article>", ["T", "a"]),
        ("<article><!-- <p>no</p> --><pre>a\n  b</pre><style>p{}</style>&#233;&nbsp;&lt;", ["a b", "é <"]),
    ],
)
def test_parse(html, want):
    assert maintext.parse(html)[0] == want


def test_covered_positions_by_brute_force():
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 3, 40) for _ in range(5)]
    tokens = np.concatenate([np.append(p, 10 + k) for k, p in enumerate(pages)])
    page = np.repeat(np.arange(5), 41)
    holders = {}
    for k in range(len(tokens) - 3):
        holders.setdefault(tuple(tokens[k : k + 4]), set()).add(page[k])
    want = np.zeros(len(tokens), dtype=bool)
    for k in range(len(tokens) - 3):
        if len(holders[tuple(tokens[k : k + 4])]) >= 3:
            want[k : k + 4] = True
    assert (maintext.covered_positions(tokens, page, long=4, pages=3) == want).all()


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("a/LICENSE", mit), ("a/x.txt", "text"), ("a/b/y.txt", "deep"), ("a/c/COPYING.md", gpl), ("a/c/d/z.txt", "deeper"),
        ("a/c/own.txt", f"code\n# {mit}\ncode"), ("top.txt", "nothing"), ("q/n.txt", None), ("q/e.txt", ""), (None, mit), ("a/x.txt", "text"),
        ("ab/x.txt", "not below a"),
    ]
    files = spark.createDataFrame([(p, t, "old") for p, t in rows], "path string, text string, licence string")
    got = [(r.path, r.licence, r.origin) for r in licences.scan(files).collect()]
    want = [
        ("a/LICENSE", "MIT", "file"), ("a/x.txt", "MIT", "inherited"), ("a/b/y.txt", "MIT", "inherited"),
        ("a/c/COPYING.md", "GPL-3.0", "file"), ("a/c/d/z.txt", "GPL-3.0", "inherited"), ("a/c/own.txt", "MIT", "header"),
        ("top.txt", None, None), ("q/n.txt", None, None), ("q/e.txt", None, None), (None, "MIT", "header"), ("a/x.txt", "MIT", "inherited"),
        ("ab/x.txt", None, None),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licences.scan(files.where("false")).count() == 0


def test_licence_statements_are_compared_without_a_shuffle_of_words(spark):
    rows = [("a/LICENSE", "Released under the MIT License.\n", True), ("b.txt", " \n", False)]
    files = spark.createDataFrame(rows, "_row string, text string, is_licence_file boolean")
    found = licences.own_licences(files)
    assert [(r["_row"], r.licence) for r in found.collect()] == [("a/LICENSE", "MIT")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert keys and all(re.fullmatch(r"_row#\d+", k) for k in keys)


MIT_FILE = """MIT License

Copyright (c) 2024 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
GPL_HEADER = """/*
 * A tool. This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version.
 */
int main() {{ return 0; }}"""


def test_standard_licence_texts(spark):
    filler = "\n".join(sentence(random.Random(4), 9) for _ in range(30))
    files = {
        "mit/LICENSE": (MIT_FILE, "MIT"),
        "a.c": (GPL_HEADER.format(3) + "\n" + filler, "GPL-3.0"),
        "b.c": (GPL_HEADER.format(2) + "\n" + filler, "GPL-2.0"),
        "c.py": ("# SPDX-License-Identifier: MIT\n" + filler, "MIT"),
        "d.rs": ("// SPDX-License-Identifier: Apache-2.0\n" + filler, "Apache-2.0"),
        "e.rs": ("// SPDX-License-Identifier: GPL-3.0-or-later\n" + filler, "GPL-3.0"),
        "f.rs": ("// SPDX-License-Identifier: Zlib\n" + filler, None),
        "g.txt": ("The MIT License (MIT)", "MIT"),
        "h.txt": ("Mozilla Public License Version 2.0", "MPL-2.0"),
        "i.txt": ("BSD 2-Clause License", "BSD-2-Clause"),
        "gpl/COPYING": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + filler, "GPL-3.0"),
        "j.txt": (filler, None),
        "k.txt": ("A driving license is needed. Copyright reserved.\n" + filler, None),
    }
    rows = spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string")
    got = {r.path: r.licence for r in licences.scan(rows).collect()}
    assert got == {p: found for p, (_, found) in files.items()}


@pytest.mark.parametrize(
    "inner, text",
    [
        ('<h2 id="search">Search</h2><h3 id="related-work">Other work</h3>', "Search\nOther work"),
        ('<section id="comment-syntax">Notes</section><p class="share-price">Up</p>', "Notes\nUp"),
        ('<div class="ad-hoc-analysis">Ad hoc</div><math><mi>x</mi></math>', "Ad hoc\nx"),
        ('<p>One <button>press</button> two <span class="advert">buy</span> three</p>', "One two three"),
        ('<p>a<svg><svg><text>in</text></svg>out</svg>b</p>', "ab"),
        ('<div class="share-buttons">x</div><section id="comments">y</section><div class="readerComments">z</div>', ""),
        ('<p class="notice">x</p><div role="navigation">y</div><p hidden>z</p><p>kept</p>', "kept"),
        ("<p>1 < 2 and a <b tail", "1 < 2 and a <b tail"),
        ("<p>x</p></article><script>var a = '</p>'</script ><footer>f</footer>", "x"),
    ],
)
def test_main_text_takes_whole_labels(inner, text):
    for page in (f"<body><article>{inner}</article></body>", f'<div class="widget"><main>{inner}</main></div>'):
        assert "\n".join(maintext.parse(page)[0]) == text


@pytest.mark.parametrize(
    "part, n",
    [
        ("<a ", 300_000), ('<a "', 250_000), ("<a x='", 200_000), ('"<a" ', 200_000), ("<!", 500_000),
        ("</article>", 100_000), ("<b><hr>", 100_000), ("</script ", 100_000), ("<i><p><b></i>", 50_000),
    ],
)
def test_broken_markup_is_read_in_linear_time(part, n):
    import time

    start = time.perf_counter()
    maintext.parse("<article><script></script><a " + part * n)
    maintext.parse("<div>" * 20_000 + part * (n // 4))
    assert time.perf_counter() - start < 10
