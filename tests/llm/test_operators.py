"""Every operator against brute force: odd texts, nulls, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import decontaminate, jaccard, language, lines, packing, quality, rules, substrings, tokens, urls
from sievework.llm.queries import tokenizer_path
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, id string, key string, term string, n int, bucket int, lines string, n_words string, kept string"


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "the", "naïve", "Größe", "日本語"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [text(n) for n in (1, 4, 5, 6, 9, 10, 19, 20, 21, 40, 80, 200)]
    passage = text(30)
    near = base[-1].split()
    near[100] = "changed"
    return [
        None, "", " ", "\n\n", "\t \x0b", *base, *base[-3:], " ".join(near), passage, text(15) + " " + passage + "\n" + text(9), passage + " " + passage,
        "a b\nc d\ne f\n\na b\nc d\ne f", "x y\nc d\ne f\nz", "same line\nsame line\nsame line\nsame line", "THE w1 w2 W3 w4, w5", "the W1 w2 w3 w4, w5",
        "12 #$% **", text(3000), (text(700) + "\n") * 3, "nospaces" * 3000, "é é", "<|endoftext|> a<|endoftext|>b <|startoftext|>",
    ]


@pytest.fixture(scope="module")
def rows():
    texts = odd_texts()
    out = [(i * 3 % 41, t) for i, t in enumerate(texts)]
    return out + [(7, texts[-3]), (7, texts[16]), (None, texts[16]), (None, texts[15]), out[8], out[8]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, "x", "y", "z", 1, 2, "l", "m", "k") for i, t in rows], DOCS).repartition(3)


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_decontaminate(spark, rows):
    items = [(1, rows[30][1]), (2, "W5 w5"), (10, rows[13][1]), (3, None), (4, ""), (None, "w1 w2"), (5, rows[15][1]), (6, "W5, w5!"), (7, "absent words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontaminate(rows, items)
    got = decontaminate.decontaminate(frame(spark, rows), bench)
    same(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").collect(), want)
    assert any(w[2] for w in want)
    blocks = decontaminate.decontaminate(frame(spark, rows), bench, block_bytes=300)
    same(blocks.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").collect(), want)
    none = decontaminate.decontaminate(frame(spark, rows), bench.limit(0))
    assert {r.n_hit for r in none.collect()} == {0}
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, 0, "rare x x x odd"), (2, 0, "rare " + "x " * 30 + "odd"), (3, 0, "x")], "id long, key long, text string")
    items = spark.createDataFrame([(5, "the rare one is odd", ["a"])], "pid long, phrase string, items array<string>")
    counts = spark.createDataFrame([("the", 99), ("rare", 2), ("one", 80), ("is", 70), ("odd", 2)], "term string, n long")
    chosen = decontaminate.anchors(items, counts, 10, 2)
    index = decontaminate.postings(docs, chosen.select("term").distinct(), 10)
    assert [tuple(r) for r in decontaminate.proximity(index, chosen, 8).collect()] == [(1, 0, 5, 2, 0, 4)]


def test_proximity_matches(spark):
    """Against brute force: shuffled, spread and damaged passages, some within the span."""
    rng = random.Random(21)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(n))) for i, n in enumerate((3, 10, 11, 25, 40))] + [(7, None), (None, "c1 r1"), (8, "absent words only")]
    docs = []
    for i in range(80):
        words = [rng.choice(common) for _ in range(60)]
        part = rng.choice(items[:5])[1].split()
        rng.shuffle(part)
        for w in part[: rng.randrange(8)]:
            words.insert(rng.randrange(len(words)), w)
        docs.append((i if i % 11 else None, " ".join(words)))
    docs += [(500, None), (501, ""), (502, items[1][1]), docs[3], docs[3]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for span in (1, 6, 20):
        got = decontaminate.proximity_matches(frame(spark, docs), bench, span)
        same(got.collect(), brute.proximity(docs, items, span))
    assert decontaminate.proximity_matches(frame(spark, []), bench).isEmpty() and decontaminate.proximity_matches(frame(spark, docs), bench.limit(0)).isEmpty()


def test_substring_dedup(spark, rows):
    got = substrings.substring_dedup(frame(spark, rows)).collect()
    want = brute.substring_dedup(rows)
    same([(r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in got], want)
    assert any(w[2] for w in want)
    for r in got:
        assert sum(x["end"] - x["first"] for x in r.removed) == r.n_removed
    small = substrings.substring_dedup(frame(spark, rows), block_bytes=500).collect()
    same([(r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in small], want)
    assert substrings.substring_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substrings.substring_dedup(frame(spark, rows), window=10)


def test_substring_rows_of_one_id(spark):
    """Texts that share an id, null or not, keep what is their own, even where short hashes of them collide; a null id comes after the largest and is not id 0."""
    w, v = (" ".join(f"{c}{i}" for i in range(25)) for c in "wv")
    for id_ in (None, 7):
        rows = [(1, w), (id_, w + " x2313"), (id_, v + " y81814")]
        same([(r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in substrings.substring_dedup(frame(spark, rows)).collect()], brute.substring_dedup(rows))
    rows = [(None, v), (0, v), ((1 << 63) - 1, v), (None, w), ((1 << 63) - 1, w), (0, "a " + v), (0, "b " + v)]
    same([(r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in substrings.substring_dedup(frame(spark, rows)).collect()], brute.substring_dedup(rows))


CLASHES = "doc_id long, text string, `kept` string, `tail_probability` string, `__key` string, `a.b` int, `__text` string, `__near` int, `__word` int, `__place` int, `__marks` string, key string, c1 string, `rest` string, `__` int"


def clashing(spark, rows):
    """Rows of (doc_id, text) with columns that are named like those of steps, or oddly."""
    return spark.createDataFrame([(i, t, "user", "odd", f"k{n}", n, "t", 1, 2, 3, "m", "key", "c", "r", n) for n, (i, t) in enumerate(rows)], CLASHES).repartition(3)


def test_columns_of_the_user_pass(spark, rows):
    df = clashing(spark, rows)
    rest = [c for c in df.columns if c != "text"]
    as_rows = lambda d, names: sorted((tuple(r[n] for n in names) for r in d.collect()), key=str)
    counted = tokens.token_counts(df, tokenizer_path("byte_bpe_50k.json"))
    assert counted.columns == [*rest, "n_bytes", "n_tokens", "over_limit"] and as_rows(counted, rest) == as_rows(df, rest)
    assert as_rows(lines.line_dedup(df), rest) == as_rows(df, rest)
    model = quality.Ordinal(np.zeros(1 << quality.Fit().bits, np.float32), np.array([-1.0, 1.0]))
    scored = quality.score(df, model, wanted=2)
    own = [c for c in df.columns if c not in ("kept", "tail_probability")]
    assert scored.columns == [*own, "expected_grade", "tail_probability", "kept"] and as_rows(scored, own) == as_rows(df, own)
    net = language.held_out_languages(df.withColumn("lang", F.lit("en")))
    assert net.count() == len(rows)
    assert jaccard.jaccard_components(df).count() == substrings.substring_dedup(df).count() == len(rows)


def test_every_shift_meets_the_cover():
    cover = set(substrings.COVER)
    for d in range(substrings.PERIOD):
        assert any(k in cover and (k + d) % substrings.PERIOD in cover for k in range(substrings.PERIOD))


def test_jaccard(spark, rows):
    rng = random.Random(2)
    more = []
    for i in range(60):  # chains of edits around the threshold
        words = [f"v{rng.randrange(400)}" for _ in range(rng.choice([6, 9, 14, 30, 70, 150]))]
        for j in range(6):
            more.append((1000 + 10 * i + j, " ".join(words)))
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(400)}"
    for docs in (rows, more, rows + more):
        want = brute.jaccard_components(docs)
        same([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, docs)).collect()], want)
    small = jaccard.jaccard_components(frame(spark, more), block_bytes=2000)
    same([tuple(r) for r in small.collect()], brute.jaccard_components(more))
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0


def test_jaccard_with_a_shared_passage(spark):
    """Short documents that hold the same passage: many unsettled groups, few links."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([3, 6, 9, 12, 40])))) for i in range(150)]
    same([tuple(r) for r in jaccard.jaccard_components(frame(spark, docs)).collect()], brute.jaccard_components(docs))


def test_segments_are_few_and_enough():
    for size in (1, 4, 9, 50, 500, 5000):
        number, lo, hi = jaccard.band(size)
        assert lo <= size <= hi and jaccard.segments(lo, hi) >= hi // 4 + 1
        assert jaccard.segments(lo, hi) <= 8 * lo + hi // 4 + 2


def test_line_dedup(spark, rows):
    for least in (2, 3):
        got = lines.line_dedup(frame(spark, rows).drop("lines", "n").withColumnRenamed("bucket", "lines"), least, counts=True)
        same([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()], brute.line_dedup(rows, least))
        assert set(got.columns) >= {"doc_id", "text", "lines", "lang", "n_lines", "n_removed"}
    assert any(w[3] for w in brute.line_dedup(rows))
    assert lines.line_dedup(frame(spark, [])).count() == 0


def test_quality_rules(spark, rows):
    got = rules.quality_rules(frame(spark, rows)).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], [(i, *brute.text_stats(t)) for i, t in rows])
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)  # too few rows for a fence
    assert rules.quality_rules(frame(spark, [])).count() == 0


def test_quality_rules_learn_fences(spark):
    rng = random.Random(1)
    good = [(i, " ".join(f"word{rng.randrange(10**6)}" for _ in range(60))) for i in range(300)]
    bad = [(1000 + i, " ".join(f"word{rng.randrange(10**6)}###" for _ in range(60))) for i in range(20)]
    got = {r.doc_id: r.kept for r in rules.quality_rules(frame(spark, good + bad)).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad)


def test_quality_rules_keep_what_brute_force_keeps(spark):
    """Fences by exact quantiles of small groups, with the fallbacks to the language and the whole."""
    rng = random.Random(17)

    def text(words, symbols, long, dups):
        body = [("w" * rng.randrange(3, long) if rng.random() > symbols else "##|") + str(rng.randrange(10**6)) for _ in range(words)]
        lines_ = [" ".join(body[i : i + 6]) for i in range(0, words, 6)]
        return "\n".join(lines_ + [lines_[0]] * dups)

    data = []
    for lang, source, n in (("en", "a", 150), ("en", "b", 60), ("de", "a", 40), (None, None, 110)):
        for _ in range(n):
            odd = rng.random() < 0.15
            data.append((len(data), text(rng.randrange(12, 60), 0.6 if odd and rng.random() < 0.5 else 0.02, 30 if odd else 8, 1 if odd and n % 20 == 0 else 0), lang, source))
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(3)).collect()}
    f = rules.Fences()
    stats = {i: dict(zip(rules.STATS, rules.text_stats(t))) for i, t, _, _ in data}
    base = {i for i, s in stats.items() if s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]}
    ratio = {i: {k: s[x] / max(1, s[y]) for k, (x, y, _) in rules.RATIOS.items()} for i, s in stats.items()}

    def fences(chosen):
        out = {}
        for k, (_, _, low) in rules.RATIOS.items():
            v = sorted(ratio[i][k] for i in chosen)
            q = [v[max(0, math.ceil(p * len(v)) - 1)] for p in (0.25, 0.5, 0.75)]
            width = max(f.spreads * (q[2] - q[0]), getattr(f, k))
            out[k] = (q[1] - width if low else -1.0, q[1] + width)
        return out

    by = {}
    for i, _, lang, source in data:
        if i not in base:
            for key in ((lang, source), (lang,), ()):
                by.setdefault(key, []).append(i)
    want = {}
    for i, _, lang, source in data:
        key = next((k for k in ((lang, source), (lang,), ()) if len(by.get(k, ())) >= f.least_rows), None)
        fence = fences(by[key])
        want[i] = i not in base and all(fence[k][0] <= ratio[i][k] <= fence[k][1] for k in rules.RATIOS)
    near = {i for i in want if got[i].kept != want[i]}
    assert {i for i, r in got.items() if r.base_failed} == base
    assert len(near) <= 2  # a sketch of over 200 values may miss a quantile by a place
    assert 5 <= sum(not k for i, k in want.items() if i not in base) <= 100


def test_token_counts(spark, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    got = tokens.token_counts(frame(spark, rows), path, batch_bytes=300)
    assert {"lang", "key", "n"} <= set(got.columns) and "text" not in got.columns
    want = [(i, len((t or "").encode()), (n := len(whole.encode(t or "", add_special_tokens=False).ids)), n > 512) for i, t in rows]
    same([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()], want)
    assert tokens.token_counts(frame(spark, []), path).count() == 0
    counter = tokens.PieceCounter(path, batch_bytes=50, remembered_bytes=2000)
    texts = [t or "" for _, t in rows]
    assert counter.counts(texts) == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]


def odd_strings(n: int) -> list[str]:
    rng = random.Random(3)
    parts = ["a", "B", " ", "'s", "\n", "\t", ".", "!", "<|endoftext|>", "É", "é", "Σ", "1", " ", "　", "\x1c", "​", "ß", "  ", "日本"]
    return ["".join(rng.choice(parts) for _ in range(60)) for _ in range(n)]


def test_texts_without_spaces_and_many_long_words():
    """Long pieces are cut where the library agrees, and long words do not pile up."""
    from tokenizers import Tokenizer

    rng = random.Random(3)
    parts = ["abc", "'ll", "'s", "123", "!!", "日本", "é", "<|endoftext|>", "'", "l", "don't", "x1", "#", "ß", "“"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(100, 1500))) for _ in range(100)]
    path = tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    want = [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    for longest in (40, 200, 1 << 14):
        assert tokens.PieceCounter(path, longest=longest).counts(texts) == want
    big = "".join(rng.choice(parts) for _ in range(1_700_000))
    assert len(big.encode()) > 5_000_000
    counter = tokens.PieceCounter(path)
    assert counter.counts([big]) == [len(whole.encode(big, add_special_tokens=False).ids)]
    words = ["%030x%040x" % (rng.getrandbits(120), rng.getrandbits(160)) for _ in range(100_000)]
    counter.counts([" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)])
    assert not counter.known or max(map(len, counter.known)) <= tokens.LONG
    encoder = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    for i in range(0, len(words), 10_000):
        text = " ".join(words[i : i + 10_000])
        (ids,) = encoder.encode([text])
    assert len(ids) // 4 == len(Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids)
    assert not encoder.words and not encoder.cores
    small = packing.WordIds(tokenizer_path("word_bpe_49k.json"), remembered_bytes=100_000)
    assert small.encode([" ".join(f"w{i}" for i in range(5000)), "w1 w2"])[1] == small.encode(["w1 w2"])[0] and not small.words.keys() - {"w1", "w2"}
    features = quality.Features(18, remembered_bytes=100_000)
    for i in range(0, 20_000, 100):
        features.of(" ".join(words[i : i + 100]) + " short")
    assert len(features.known) < 2000 and all(len(w) <= 64 for w in features.known)


def test_pieces_and_words_tokenize_like_whole_texts():
    from tokenizers import Tokenizer

    texts = odd_strings(500)
    path = tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    assert tokens.PieceCounter(path).counts(texts) == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    path = tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    for text, ids in zip(texts, packing.WordIds(path, remembered_bytes=20_000).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_words_are_known_by_their_letters():
    """Cases and punctuation of one word are learned once, and batches of any letters give the library's ids."""
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    encoder, whole = packing.WordIds(path), Tokenizer.from_file(path)
    texts = ["Straße word, WORD. word!? (word) Éa éa; ÉA", "ẞ ÿ Ÿ ª µ × a÷ a\u0301 İa don't a\u00a0b", "", " ", "\n\n", "a" * 100 + " " + "é" * 70 + "."]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert {c for c in encoder.cores if c.isalpha()} >= {"straße", "word", "éa"} and not encoder.words.keys() & {"Straße", "word,", "WORD.", "word!?", "éa;"}
    assert max(map(len, [*encoder.cores, *encoder.words])) <= packing.LONG and encoder.encode([]) == []


def check_packing(rows, docs, limits, loss=False):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == limits.tokens or at & (at - 1) == 0
        assert at <= limits.tokens and len(own) <= limits.segments and sum(r.loss_tokens for r in own) <= limits.loss_tokens
    return by_doc


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    for limits in (packing.Limits(4096, 64, 4096), packing.Limits(64, 4, 64), packing.Limits(256, 3, 100)):
        unique = [(i, t) for i, (_, t) in enumerate(rows)]
        got = packing.pack_examples(frame(spark, unique), path, limits=limits, batch_chars=500).collect()
        by_doc = check_packing(got, unique, limits)
        assert len(by_doc) == len(unique)
        for (doc, n), pieces in by_doc.items():
            ids = np.array(whole.encode(unique[doc][1] or "", add_special_tokens=False).ids + [2], "<u4")
            assert n == len(ids)
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == n
    assert packing.pack_examples(frame(spark, []), path).count() == 0
    assert sum(r.length for r in packing.pack_examples(frame(spark, rows), path).collect()) == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)


def test_packing_counts_loss_after_the_prompt(spark):
    data = [(i, "please answer this " * (i % 7), "a long answer follows here " * (i % 9)) for i in range(80)] + [(99, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, prompt string, text string")
    limits = packing.Limits(128, 5, 40)
    got = packing.pack_examples(docs, tokenizer_path("word_bpe_49k.json"), limits=limits, prompt_col="prompt").collect()
    by_doc = check_packing(got, data, limits)
    for i, prompt, _ in data:
        pieces = [r for (d, _), rs in by_doc.items() if d == i for r in rs]
        free = 3 * (i % 7) if prompt else 0
        assert sum(r.loss_tokens for r in pieces) == sum(r.length for r in pieces) - free


RULES = (urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/"))


def test_urls(spark):
    cases = {
        "http://Example.COM/en/x?y": ("example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://m.www.example.com/en/a#b": ("m.www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "ftp://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
        "http://a.com": ("a.com", "", None, "allow"), "http://a.org?x=/en/": ("a.org", "", None, "allow"),
        "http://a.org/p#://b.com/": ("a.org", "/p", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "://": ("", "", None, "allow"),
        "http://ÄB.org/É": ("Äb.org", "/É", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate([*cases, *cases])], "page_id long, url string, host string, n int")
    none = spark.createDataFrame([], "page_id long, bad int")
    for r, u in zip(sorted(urls.filter_urls(pages, none, RULES).collect()), [*cases, *cases]):
        assert (r.host, r.path, r.rule, r.verdict) == cases[u], u
    assert urls.filter_urls(pages.limit(0), none, RULES).count() == 0
    table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in RULES] + [("block", f"h{i}.io", "/") for i in range(3000)], "verdict string, host string, path string")
    for r, u in zip(sorted(urls.filter_urls(pages, none, table).collect()), [*cases, *cases]):
        assert (r.host, r.path, r.rule, r.verdict) == cases[u], u
    assert urls.filter_urls(pages, none, table.limit(0)).where("rule is not null or verdict <> 'allow'").isEmpty()


def test_host_reputation_shrinks(spark):
    data = [("bad.x.org", 200, 190), ("good.x.org", 200, 5), ("new.x.org", 0, 0), ("few.y.org", 2, 2), ("a.y.org", 300, 10), ("b.z.com", 500, 20), ("c.co.uk", 1, 0)]
    r = {x.host: x for x in urls.host_reputation(spark.createDataFrame(data, "host string, n long, k long")).collect()}
    assert len(r) == len(data)
    assert r["bad.x.org"].blocked and not any(r[h].blocked for h in ("good.x.org", "a.y.org", "b.z.com", "c.co.uk"))
    assert r["few.y.org"].mean < 0.9 and r["good.x.org"].mean < r["new.x.org"].mean < r["bad.x.org"].mean
    assert urls.host_reputation(spark.createDataFrame([], "host string, n long, k long")).count() == 0


def test_host_bounds_are_those_of_sampled_posteriors(spark):
    """Hosts drawn around domains: the bound is met by a sampled beta posterior, and blocked hosts are truly worse than the average."""
    rng = np.random.default_rng(3)
    data, truth = [], {}
    for d in range(12):
        centre = rng.beta(2, 8)
        for h in range(8):
            name, n = f"h{h}.d{d}.org", int(rng.integers(0, 120))
            truth[name] = rng.beta(1 + 20 * centre, 1 + 20 * (1 - centre))
            data.append((name, n, int(rng.binomial(n, truth[name]))))
    got = urls.host_reputation(spark.createDataFrame(data, "host string, n long, k long")).collect()
    base = sum(k for *_, k in data) / sum(n for _, n, _ in data)
    m = {x.host: x for x in got}
    for name, n, k in data:
        x = m[name]
        strength = (x.mean * n - k) / (prior - x.mean) if abs((prior := m_prior(m, data, name)) - x.mean) > 1e-6 else None
        if strength:  # the prior's strength, seen from outside: sample the posterior it gives
            sample = rng.beta(strength * prior + k, strength * (1 - prior) + n - k, 40_000)
            assert abs(np.quantile(sample, 0.05) - x.bound) < 0.03, name
        assert x.blocked == (x.bound > base)
    blocked = [h for h, x in m.items() if x.blocked]
    assert 5 <= len(blocked) <= 60 and sum(truth[h] > base for h in blocked) >= 0.9 * len(blocked)


def m_prior(found, data, name):
    """The prior mean of a host: that of a host of its domain without outcomes, solved from two hosts of the domain."""
    domain = name.split(".", 1)[1]
    own = [(n, k, found[h].mean) for h, n, k in data if h.endswith(domain)]
    rows = np.array([[1.0, -mean] for n, _, mean in own])  # strength * prior - mean * strength = mean * n - k
    right = np.array([mean * n - k for n, k, mean in own])
    both = np.linalg.lstsq(rows, right, rcond=None)[0]
    return both[0] / both[1]


def test_suffixes(spark, tmp_path):
    (tmp_path / "suffixes.txt").write_text("// comment\n\ncom\nuk\nco.uk\n*.ck\n!www.ck\nblogs.com  trailing\n")
    table = urls.read_suffixes(spark, str(tmp_path / "suffixes.txt"))
    want = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "x.uk": ("x.uk", "uk"), "co.uk": ("co.uk", "co.uk"), "a.b.other.ck": ("b.other.ck", "other.ck"), "m.www.ck": ("www.ck", "ck"),
        "me.blogs.com": ("me.blogs.com", "blogs.com"), "a.me.blogs.com": ("me.blogs.com", "blogs.com"), "a.unknown": ("a.unknown", "unknown"), "single": ("single", "single"),
    }
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: (r.domain, r.suffix) for r in urls.with_suffix(hosts, table).collect()} == want
    rule = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.y.com.mx": ("y.com.mx", "com.mx"), "x.y.de": ("y.de", "de"), "x.co.com": ("co.com", "com"), "single": ("single", "single")}
    hosts = spark.createDataFrame([(h,) for h in rule], "host string")
    assert {r.host: (r.domain, r.suffix) for r in urls.with_suffix(hosts, None).collect()} == rule


def test_urls_by_reputation(spark):
    """Pages without a rule take their host's verdict, and only those."""
    pages = [(i, f"http://{h}/p/{i}") for i, h in enumerate(["bad.org"] * 60 + ["good.org"] * 60 + ["sub.example.com"] * 10)]
    outcomes = [(i, int(u.startswith("http://bad") or i % 20 == 0)) for i, u in pages if i % 2 == 0] + [(None, 1), (3, None), (4, 0)]
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"), RULES).collect()
    assert {(r.host, r.rule, r.verdict) for r in got} == {("bad.org", None, "block"), ("good.org", None, "allow"), ("sub.example.com", "com/", "allow")}


def test_language_id_holds_out(spark):
    rng = random.Random(4)
    parts = {"aa": ["kel", "mor", "tin"], "bb": ["zou", "fei", "xan"], "cc": ["är", "öl", "gün"]}
    word = lambda p: "".join(rng.choice(parts[p]) for _ in range(rng.randrange(1, 4)))
    data = [(i, " ".join(word(p) for _ in range(30)), p) for i in range(150) for p in [rng.choice(list(parts))]]
    extra = [(900, None, "aa"), (901, "", "bb"), (902, "12 34!", "aa"), (903, "kelmortin", None), (None, "zouzou fei", "bb"), data[0], data[0], (904, "kel" * 2000, "aa")]
    docs = spark.createDataFrame(data + extra, "doc_id long, text string, lang string")
    got = language.held_out_languages(docs, language.Training(steps=200)).collect()
    assert len(got) == len(data + extra)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    held = [(by[i].lang_pred, p) for i, _, p in data if by[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert language.held_out_languages(docs.limit(0)).count() == 0


def test_language_sample_has_every_language_and_a_bound(spark):
    """Two hundred languages of few documents are all learned; long documents give a bounded part, drawn alike each time."""
    rows = [(i, f"text {i} " + ("x" * 900 if i % 40 == 0 else ""), f"l{i % 200}") for i in range(600)] + [(9999, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    t = language.Training(rows=50, steps=1, hidden=2, batch=2, chars=100)
    assert language.learn(docs, t).languages == sorted({f"l{i}" for i in range(200)})


def test_language_id_without_spaces_and_in_mixed_scripts(spark):
    """Held-out texts of scripts without spaces, and texts that mix two scripts: the larger share decides."""
    rng = random.Random(11)
    signs = {"han": "日月山川田人口木水火土金大小中上下左右天", "kana": "あいうえおかきくけこさしすせそたちつてと", "thai": "กขคงจฉชซญดตถทธนบปผพฟ", "latin": "abcdefghijklmnop"}
    text = lambda p, n: "".join(rng.choice(signs[p]) for _ in range(n))
    data = [(i, text(p, rng.choice([20, 60, 300])), p) for i in range(240) for p in [rng.choice(list(signs))]]
    mixed = [(1000 + i, text(p, 60) + text(q, 20) + text(p, 60), p) for i in range(60) for p, q in [rng.sample(["han", "kana", "thai"], 2)]]
    mixed += [(2000, text("han", 5000), "han"), (2001, text("kana", 300) * 50, "kana")]
    docs = spark.createDataFrame([*data, *((i, t, None) for i, t, _ in mixed)], "doc_id long, text string, lang string")
    by = {r.doc_id: r for r in language.held_out_languages(docs, language.Training(steps=250)).collect()}
    right = [by[i].lang_pred == p for i, _, p in data if by[i].held_out] + [by[i].lang_pred == p for i, _, p in mixed]
    assert sum(right) >= 0.97 * len(right)


def test_stretches_label_each_byte_once():
    for n in (0, 1, language.STRETCH, language.STRETCH + 1, 5 * language.STRETCH + 7):
        data = bytes(i % 251 for i in range(n))
        assert b"".join(s[a:b] for s, a, b in language.stretches(data)) == data
    rng = np.random.default_rng(1)
    net = language.ByteGru(["x", "y"], 6, 2)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (1, 30, 200, 400)]
    for x, got in zip(texts, language.means(net, texts)):  # one stretch: state by state, as in training
        data = np.frombuffer(x, np.uint8)[:, None]
        f = np.stack([s[0] for s in net._run("f", data)])[:, 0]
        b = np.stack([s[0] for s in net._run("b", data[::-1])])[::-1, 0]
        e = np.exp(f @ net.p["vf"] + b @ net.p["vb"] + net.p["c"])
        assert np.allclose((e / e.sum(1, keepdims=True)).mean(0), got, atol=1e-4)


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    net = language.ByteGru(["x", "y", "z"], 5, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, target = rng.integers(0, 256, (4, 6)), np.array([0, 1, 2, 1])
    _, g = net.gradient(data, target)
    for name in net.p:
        i = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        loss = []
        for e in (1e-3, -2e-3):
            net.p[name][i] += e
            loss.append(net.gradient(data, target)[0])
        net.p[name][i] += 1e-3
        assert abs((loss[0] - loss[1]) / 2e-3 - g[name][i]) < 2e-3 * max(1, abs(g[name][i]))


def test_quality_classifier(spark):
    rng = random.Random(8)
    words = [f"plain{i}" for i in range(300)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    data, grades = [], []
    for i in range(600):
        g, w = rng.choice([0, 1, 2, 2]), text(rng.randrange(20, 60))
        if g == 1:
            w[rng.randrange(len(w))] = rng.choice(["nasty", "vile"])
        data.append((i, " ".join(w).upper() if g == 0 else " ".join(w), "c"))
        grades.append((i, g))
    docs = spark.createDataFrame(data + [(1000, None, "c"), (1001, "", "c"), (1002, " .. ", "c"), data[0]], "doc_id long, text string, kept string")
    ratings = spark.createDataFrame(grades[:450] + [(None, 1), (3, None), (4, 9), (5000, 1)], "doc_id long, grade int")
    model = quality.learn(docs, ratings, 3)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = quality.score(docs, model, wanted=2).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert sum(by[i].kept == (g == 2) for i, g in grades[450:]) >= 0.95 * 150
    assert all(not by[i].kept and by[i].expected_grade == 0 for i in (1000, 1001, 1002))
    mean = lambda g: np.mean([by[i].expected_grade for i, x in grades[450:] if x == g])
    assert mean(0) < mean(1) < mean(2)
    assert quality.learn(docs, ratings.limit(0), 3) is None
    assert all(r.kept == bool((r.text or "").strip(" .")) for r in quality.score(docs, None, 2).collect())
    assert quality.score(docs.limit(0), model, 2).count() == 0


def test_ordinal_fit_is_a_maximum_and_scores_are_its_probabilities(spark):
    """The fit against the likelihood written out, and the scores of rows against sums by hand."""
    rng = random.Random(21)
    words = [f"word{i}" for i in range(40)]
    data = []
    for i in range(600):
        grade = rng.randrange(3)
        marks = ["fine"] * (rng.random() < (0.1, 0.4, 0.9)[grade]) + ["awful"] * (rng.random() < (0.9, 0.4, 0.1)[grade])
        data.append((i, " ".join(rng.sample(words, 8) + marks), grade))
    f = quality.Fit(bits=12, steps=800, least_z=3.0)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in data], "doc_id long, grade int")
    model = quality.learn(docs, ratings, 3, f)
    make = quality.Features(f.bits)
    features, grades = [make.of(t) for _, t, _ in data], np.array([g for *_, g in data])
    share = np.bincount(grades, minlength=3)
    weight = (1 / share)[grades] ** 0.5
    weight /= weight.mean()

    def loss(w, theta):
        c = 1 / (1 + np.exp(-(theta[None, :] - np.array([w[x].sum() for x in features])[:, None])))
        p = np.diff(np.concatenate([np.zeros((len(c), 1)), c, np.ones((len(c), 1))], 1), axis=1)[np.arange(len(c)), grades]
        return -(weight * np.log(p)).mean() + f.decay / 2 * (w**2).sum()

    best = loss(model.weights.astype(float), model.thresholds)
    used = np.flatnonzero(model.weights)
    assert 2 <= len(used) <= 40
    for j in [*used[:6], *used[-6:]]:
        for step in (-0.3, 0.3):
            w = model.weights.astype(float).copy()
            w[j] += step
            assert loss(w, model.thresholds) > best - 1e-4
    for step in (-0.3, 0.3):
        assert loss(model.weights.astype(float), model.thresholds + step) > best - 1e-4
    for r in quality.score(docs, model, 2, f).collect():
        c = 1 / (1 + np.exp(-(model.thresholds - model.weights[make.of(r.text)].sum(dtype=float))))
        assert abs(r.tail_probability - (1 - c[1])) < 1e-6 and abs(r.expected_grade - (2 - c.sum())) < 1e-6 and r.kept == (1 - c[1] >= 0.65)


def test_remembered_words_and_waiting_workers_hold_little():
    words = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    for i in range(0, 240_000, 60_000):
        words.encode([" ".join(f"{j:06d}".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(i, i + 60_000))])
    assert words.bytes <= 32 << 20
    called = []
    from sievework.llm import common

    step = common.tidy(lambda batches: (called.append("row") or b for b in batches))
    give_back, common.give_back = common.give_back, lambda: called.append("back")
    try:
        assert list(step(iter([1, 2]))) == [1, 2] and called == ["row", "row", "back"]
    finally:
        common.give_back = give_back
