"""Tokenizer alignment, rule ledger and collocations on awkward rows, against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vacanta.llm import alignment, collocations, common, rules

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, kept string, n_words string, failed string, row string, code string, a bigint, phrase string"


def sentence(rng, n, words=("stone", "river", "grey", "walks", "over", "many", "bright", "fields")):
    return " ".join(rng.choice(words) for _ in range(n))


def awkward_rows():
    rng = random.Random(5)
    whole = "\n".join(sentence(rng, 12) for _ in range(9))
    texts = [
        (1, whole), (2, None), (3, ""), (4, " \n\t "), (5, "x"), (6, whole), (6, whole), (7, "a  b \n c\n\nd\r\ne"),
        (None, "no id but a text"), (8, sentence(rng, 30_000)), (9, "same word " * 40), (10, "é" * 50 + " ü\n\n\nß½① x"),
        (11, "%%% !!! 123 #*$"), (12, "a\x00b <|endoftext|> <s> </s> c"), (13, "a▁b"), (14, "\nstarts\nwith breaks"),
        (15, "日本語のテキスト 😀 and words\tand tabs"), (16, "one, two. ONE, two; Éa éa"), (17, "\n\n"), (18, "x" * 3000),
        (19, " leading space"), (20, "trailing space "), (21, "ends with a break\n"), (22, "tab\tstart ;\r x"),
    ]
    return [(i, t, rng.choice(["en", "xx", None]), "k", "n", "f", "r", "c", 1, "p") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- alignment -----------------------------------------------------------------------------


def plain_ends(surfaces):
    ends, at = [], 0
    for s in surfaces:
        at += len(s)
        ends.append(at)
    return ends


class PlainAligner:
    """Both libraries on whole texts, overlaps by comparing byte ranges."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=PIECES)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [k for k in range(256) if k not in printable]
        self.letters = {chr(k): k for k in printable} | {chr(256 + n): k for n, k in enumerate(others)}

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_a = [bytes(self.letters[c] for c in self.a.id_to_token(k)) for k in a]
        bytes_b = []
        for k in b:
            piece = self.b.id_to_piece(k)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            bytes_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        return a, b, bytes_a, bytes_b

    def align(self, text):
        """``(ids a, ids b, groups, links)``; links are places of overlapping tokens."""
        if not text:
            return [], [], [], []
        a, b, bytes_a, bytes_b = self.tokens(text)
        given = (" " + text).encode()
        if b"".join(bytes_a) != given or b"".join(bytes_b) != given:
            return [], [], [], []
        ends_a, ends_b = plain_ends(bytes_a), plain_ends(bytes_b)
        common = sorted(set(ends_a) & set(ends_b))
        groups, before = [], 0
        for end in common:
            groups.append(
                (
                    [k for k, e in zip(a, ends_a) if before < e <= end] if len(a) < 500 else None,
                    [k for k, e in zip(b, ends_b) if before < e <= end] if len(a) < 500 else None,
                )
            )
            before = end
        links, j = [], 0
        for i, end in enumerate(ends_a):
            start = end - len(bytes_a[i])
            while ends_b[j] <= start:
                j += 1
            k = j
            while k < len(b) and ends_b[k] - len(bytes_b[k]) < end:
                links.append((a[i], b[k]))
                k += 1
        return a, b, groups, links


def check_alignment(rows, got):
    plain = PlainAligner()
    found = [(i, plain.align(t)) for i, t in rows]
    holds = Counter(pair for _, (_, _, _, links) in found for pair in set(links))
    most = defaultdict(int)
    for (a, _), n in holds.items():
        most[a] = max(most[a], n)
    want = []
    for doc_id, (a, b, groups, links) in found:
        digest = ""
        if groups and groups[0][0] is not None:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            digest = hashlib.sha256(text.encode()).hexdigest()
        want.append(
            (doc_id, len(a), len(b), len(groups), len(links), sum(holds[p] == most[p[0]] for p in links),
             sum(holds[p] for p in links), digest)
        )
    key = lambda r: tuple((v is None, v) for v in r)
    for w, g in zip(sorted(want, key=key), sorted(map(tuple, got), key=key), strict=True):
        assert w[:7] == g[:7]
        assert not w[7] or w[7] == g[7]
        assert (g[7] == "") == (g[1] == 0)


def test_alignment_equals_the_libraries(docs):
    got = alignment.align_tokens(docs, BYTES, PIECES).collect()
    check_alignment([(r[0], r[1]) for r in awkward_rows()], got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[13].n_a == 0 and by_id[13].groups_sha256 == ""  # a word mark comes back as a space
    assert by_id[12].n_a > 0 and by_id[8].n_links == by_id[8].n_a + by_id[8].n_b - by_id[8].n_groups


def test_alignment_of_real_texts_with_rare_and_frequent_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    wanted = [(r.doc_id, r.text) for r in rows.collect()]
    for hot in (0, 300, alignment.HOT):
        check_alignment(wanted, alignment.align_tokens(rows, BYTES, PIECES, hot=hot).collect())


def test_aligner_takes_known_words_once():
    both, whole = alignment.Aligner(BYTES, PIECES), alignment.Aligner(BYTES, PIECES)
    whole.words_b = None  # every part goes to the library
    odd = ["a b\nc a", "a  b", " a", "a ", "x \u00b4y", "\ufb01 x", "a\u2581b c", "<s> </s> <0x0A>", "\u00e9 \u0301z", "a\u200bb c", "\n", ""]
    for text in odd:
        got, want = both.align(text), whole.align(text)
        assert got[:5] == want[:5] and all((x == y).all() for x, y in zip(got[5:], want[5:])), text
    asked = []

    class Counted:
        def encode(self, text):
            asked.append(text)
            return whole.pieces.encode(text)

    both.pieces = Counted()
    both.words_b.pieces = both.pieces
    assert both.align("red green red blue\nred green red")[0] > 0 and both.align("green red")[0] > 0
    assert sorted(asked) == ["blue\nred", "green", "red"]


def test_alignment_of_nothing_and_of_parts(nothing, monkeypatch):
    assert alignment.align_tokens(nothing, BYTES, PIECES).count() == 0
    both = alignment.Aligner(BYTES, PIECES)
    text = sentence(random.Random(2), 4000) + "\nIrregularities, überall:  naïve\tcafé " * 50
    whole = both.align(text)
    monkeypatch.setattr(alignment, "word_pieces", lambda t, ends: common.word_pieces(t, 300, ends))
    parts = both.align(text)
    assert whole[:5] == parts[:5] and (whole[5] == parts[5]).all() and (whole[6] == parts[6]).all()


def test_diagonals_against_common_ends():
    rng = random.Random(9)
    for _ in range(500):
        size = rng.randrange(1, 60)
        share = rng.choice([0.1, 0.5, 0.95])
        a = sorted({size, *(k for k in range(1, size) if rng.random() < share)})
        b = sorted({size, *(k for k in range(1, size) if (k in a) != (rng.random() > rng.choice([0.5, 0.97])))})
        got = []
        for i, j, n, m in alignment.alignment(a, b):
            if n > 0:
                assert n == m
                got += [((a[i + k],), (b[j + k],)) for k in range(n)]
            else:
                got.append((tuple(a[i : i - n]), tuple(b[j : j - m])))
        want, before = [], 0
        for end in sorted(set(a) & set(b)):
            want.append((tuple(x for x in a if before < x <= end), tuple(x for x in b if before < x <= end)))
            before = end
        assert got == want


# --- rules ---------------------------------------------------------------------------------


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    twice = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if twice[w] > 1 for d in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    bare = "".join(words)
    return {
        "n_words": len(words), "word_chars": len(bare), "n_symbols": len(re.findall(r"[#*$%&|<>]", bare)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_letters": sum(c.isalpha() for c in bare), "n_digits": len(re.findall("[0-9]", bare)),
        "longest_word": max(map(len, words), default=0),
    }


def test_ledger_equals_plain_rules(docs, nothing):
    rows = rules.applied(rules.ledger(docs), rules.STANDARD).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = plain_measures(r.text)
        assert {k: r[k] for k in want} == want, r.doc_id
        failed = {name for name, k in rules.BITS.items() if r.failed >> k & 1}
        assert failed == {n for n, c in rules.RULES if eval(c.replace("AND", "and"), {}, dict(want))}
        hard, soft = failed & set(rules.STANDARD.always), failed & set(rules.STANDARD.counted)
        assert r.kept == (not hard and len(soft) <= rules.STANDARD.allowed)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[9].n_repeat_words == 80 and by_id[2].failed == 1 << rules.BITS["few_words"]
    assert by_id[1].code == "c"  # other columns stay
    assert rules.ledger(nothing).count() == 0


def test_overlapping_repeats_count_every_word_once(spark):
    texts = ["a b c d e f a b c d e f x", "a b c d e " * 3, "a b c d e\nb c d e f a b c d e f", "1 2 3 4 5 6 7 8 9"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.n_repeat_words for r in rules.ledger(rows).collect()}
    assert got == {k: plain_measures(t)["n_repeat_words"] for k, t in enumerate(texts)}


def test_ablations_equal_counting(docs):
    rows = rules.ledger(docs).select("doc_id", "failed")
    masks = [r.failed for r in rows.collect()]

    def keeps(policy, failed):
        return not failed & policy.mask(policy.always) and (failed & policy.mask(policy.counted)).bit_count() <= policy.allowed

    for r in rules.ablations(rows).collect():
        policy = next(p for p in rules.POLICIES if (p.name, p.version) == (r.policy, r.version))
        bit = 1 << rules.BITS[r["rule"]]
        out = [m for m in masks if not keeps(policy, m)]
        assert r.n_failed == sum(bool(m & bit) for m in masks) and r.n_rejected == len(out)
        assert r.n_rejected_by_it_alone == sum(keeps(policy, m & ~bit) for m in out)


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    rows = rules.applied(rules.ledger(spark.read.parquet(f"{sf}/documents.parquet")), rules.STANDARD)
    clean = rows.join(labels, "doc_id").where("failed & 3 = 0")  # what the base rules keep
    assert clean.where("kept").count() >= 0.99 * clean.count()


# --- collocations --------------------------------------------------------------------------


def phrase_totals(rows):
    counts = defaultdict(Counter)
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                for k in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[k : k + size])] += 1
    return counts


def plain_collocations(rows, least, top):
    out = []
    for lang, f in phrase_totals(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in frequent.items():
            if any(p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in frequent.items() if len(q) > len(p)):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -s))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(120):
        lines = [sentence(rng, rng.randrange(1, 12), words[: rng.choice([6, 15, 40])]) for _ in range(rng.randrange(0, 6))]
        rows.append((k, rng.choice([". ", ",", "\n", " ; "]).join(lines).replace("w1 ", "W1\t"), rng.choice(["en", "en", "fr", None])))
    # phrases of one document, which no sample of other documents proposes
    return rows + [(500, "rare pair here. " * 30, "en"), (501, None, "en"), (502, "", None), (502, "Ä ä; Ä ä", "fr")]


@pytest.mark.parametrize("sample, proposed", [(4, 2), (1, 1), (1000, 1), (2, 50)])
def test_collocations_equal_counting(spark, sample, proposed):
    rows = corpus(sample)
    docs = spark.createDataFrame([(i, t, g, "x") for i, t, g in rows], "doc_id int, text string, lang string, phrase string")
    got = collocations.collocations(docs, top=40, least=5, sample=sample, proposed=proposed).collect()
    assert sorted(map(tuple, got)) == plain_collocations([(t, g) for _, t, g in rows], 5, 40)


def test_collocations_with_full_buffers(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PART", 64)
    monkeypatch.setattr(collocations, "BUFFER", 150)
    monkeypatch.setattr(collocations, "VOCABULARY", 30)
    rows = [r for r in corpus(7) if r[1]]
    frame = collocations.pd.DataFrame({"text": [t for _, t, _ in rows], "lang": [g or "und" for _, _, g in rows]})
    n, words = Counter(), 0
    for full in collocations._buffers(iter([frame[:60], frame[60:]])):
        lang = full.lang
        ids, codes, names = full.taken()
        words += (ids > 0).sum()
        by_code = [len(c) for c in collocations._codes(ids, codes, 3, collocations.Maps(), None)]
        for (size, columns, counts), total in zip(collocations._names(ids, codes, names, collocations.Maps()), by_code):
            assert counts.sum() == total
            for *row, k in zip(*columns, counts):
                n[lang, " ".join(names[i].decode() for i in row)] += int(k)
    want = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            found = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                want.update((lang or "und", " ".join(found[k : k + size])) for k in range(len(found) - size + 1))
    assert n == want and words == sum(c for (_, p), c in want.items() if " " not in p)


def test_texts_are_read_for_the_sample_and_once_more(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUFFER", 150)
    rows = [r for r in corpus(3) if r[1]]
    docs = spark.createDataFrame([(t, g or "und") for _, t, g in rows] + [(" . ", "de")], "text string, lang string")
    read, chunks = [], collocations.chunks
    monkeypatch.setattr(collocations, "chunks", lambda rows: read.append(rows.columns) or chunks(rows))
    for name in ("code_counts", "phrase_counts"):
        plain = getattr(collocations, name)
        monkeypatch.setattr(collocations, name, lambda rows, *how, plain=plain: read.append(rows.columns) or plain(rows, *how))
    got = {(r.lang, r.phrase): r.n for r in collocations.frequent(docs, least=5, sample=1).collect()}
    assert sum("text" in columns for columns in read) == 2 and len(read) > 4
    want = {(g, " ".join(p)): c for g, f in phrase_totals([(t, g) for _, t, g in rows]).items() for p, c in f.items() if c >= 5}
    assert {k: n for k, n in got.items() if k[1]} == want and got["de", ""] == 0
    chunked = chunks(docs).collect()
    assert len(chunked) > 4  # a buffer that is full is a chunk
    for row in chunked:
        ids = collocations.np.frombuffer(row.ids, collocations.np.int32)
        assert set(ids) - {0} == set(range(1, len(row.words.split()) + 1)) and len(row.codes) == 8 * (len(row.words.split()) + 1)


def test_collocations_of_awkward_rows(docs, nothing):
    rows = [(r[1], r[2]) for r in awkward_rows()]
    got = collocations.collocations(docs, least=3).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, 3, collocations.TOP)
    assert collocations.collocations(nothing).count() == 0


def test_scores_pass_64_bits(spark):
    # the quotient of the query, on counts that no test table can hold
    big = spark.createDataFrame([(10**13, 10**13 + 7, 10**13 + 9)], "a bigint, l bigint, r bigint")
    exact = "cast(1000000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0))"
    score = big.select(F.expr(f"({exact}) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))").alias("s")).first().s
    assert score == 10**6 * 10**26 // ((10**13 + 7) * (10**13 + 9))
