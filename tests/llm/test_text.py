import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, language_id, lattice, pseudonyms, queries, quotations, secrets, sentencepiece_sampling
from leafmill.llm import wordhash as W
from leafmill.llm.queries import QUERIES
from tests.llm import plain
from tests.llm.conftest import AWKWARD


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


# --- decontamination ---

ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, "..."), (None, "no id at all"), (5, "short item"), (6, "日本語 text")]


def contaminated(spark, docs, items, **options):
    items = spark.createDataFrame(items, "item_id long, text string") if isinstance(items, list) else items
    rows = decontaminate.decontaminate(docs, items, **options).collect()
    return sorted(((r.doc_id, r.found.n_words, r.found.n_hit, r.found.items) for r in rows), key=repr), rows


@pytest.mark.parametrize("block_windows", [1, 200_000])
def test_decontamination(spark, block_windows):
    docs = [(1, "ONE two, three four five six seven eight nine ten eleven"), (2, "a short, ITEM here short-item"), (3, "two three four five six seven eight nine ten"), (4, None), (5, "日本語 text. No id at all"), (7, "no ID at all, short item"), (6, "two three four five six seven eight nine ten eleven twelve")]
    found, rows = contaminated(spark, frame(spark, docs), ITEMS, block_windows=block_windows)
    assert found == sorted(plain.contamination(docs, ITEMS), key=repr)
    texts = {r.doc_id: r.found.text for r in rows}
    assert texts[2] == "a  here " and texts[3] == docs[2][1] and texts[4] == "" and texts[6] == " twelve"


def test_shared_and_long_windows(spark):
    """One window of many items; words so long that their windows are compared by digest."""
    huge = "h" * 5000
    items = [(i, "the same short item") for i in range(300)] + [(None, "the same short item"), (1000, f"{huge} a b"), (1001, f"{huge}x a b")]
    docs = [(1, "x the same short item"), (2, f"see {huge} a b"), (3, f"{huge} a c")]
    for block_windows in (7, 200_000):
        found, _ = contaminated(spark, frame(spark, docs), items, block_windows=block_windows)
        assert found == plain.contamination(docs, items)
    assert found[0][2:] == (4, [*sorted(str(i) for i in range(300)), None]) and found[1][2:] == (3, ["1000"]) and found[2][2] == 0


def test_decontamination_of_documents(spark, documents, small, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    pairs = [(r.item_id, r.text) for r in items.collect()]
    found, _ = contaminated(spark, documents, items)
    assert found == sorted(plain.contamination(small, pairs), key=repr)
    assert contaminated(spark, documents, items, block_windows=400)[0] == found


def test_decontamination_of_awkward_rows(spark, awkward, nothing):
    found, rows = contaminated(spark, awkward, ITEMS[:2])
    assert found == sorted(plain.contamination(AWKWARD, ITEMS[:2]), key=repr)
    assert contaminated(spark, awkward, [])[0] == sorted(plain.contamination(AWKWARD, []), key=repr)
    assert contaminated(spark, nothing, ITEMS)[0] == []


# --- secrets ---

KEY = "AKIA" + "Q2W3E4R5T6Y7U8I9"


def test_secret_spans_and_verdicts(spark):
    common = "token = 'abcdef123456x7'"
    docs = [(i, f"é {common} end", f"o{i % 4}") for i in range(6)] + [(10, f"x {KEY} password:hunter22 aB3dE5gH7jK9mN1pQ3rS5tU7", "o9"), (11, "AKIASHORT deadbeef", None), (12, None, None), (13, "secret=abc token: api_key: zyxwvu", "o1"), (14, "PASSWD=\"0123456789abcdef0123456789abcdef\"", "o1")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = {r.doc_id: r.spans for r in secrets.scan_secrets(df).collect()}
    for i, text, _ in docs:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in found[i] if s.kind != "owned"] == plain.secrets(text)
    assert {s.verdict for i in range(6) for s in found[i]} == {"example"}
    assert [(s.kind, s.verdict) for s in found[10]] == [("access", "live"), ("assign", "weak"), ("owned", "live")]
    assert [(s.owners, s.repositories) for s in found[0]] == [(4, 6)] and found[12] == [] and len(found[14]) == 2


def test_widely_copied_random_strings_are_no_secrets(spark):
    docs = [(i, "id aB3dE5gH7jK9mN1pQ3rS5tU7 here", f"o{i}") for i in range(5)]
    assert all(r.spans == [] for r in secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect())


@pytest.mark.parametrize("copies", [10, 30])
def test_copies_of_one_owner_stay_secrets(spark, copies):
    docs = [(i, "id aB3dE5gH7jK9mN1pQ3rS5tU7 here", "o1") for i in range(copies)] + [(100 + i, f"id zB3dE5gH7jK9mN1pQ3rS5tU8 {KEY}", f"o{i % 2}") for i in range(copies)]
    found = {r.doc_id: r.spans for r in secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert all([(s.kind, s.verdict, s.owners, s.repositories) for s in found[i]] == [("owned", "live", 1, copies)] for i in range(copies))
    assert all([(s.kind, s.verdict) for s in found[100 + i]] == [("access", "example")] for i in range(copies))


def test_candidates_of_any_length_and_place():
    key = "aB3dE5gH7jK9mN1pQ3rS5tU7"
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    long = "".join(random.Random(1).choices("abcdefghijkLMNOPQRSTUVWXYZ0123456789", k=5000))

    def values(text):
        return [text[s:e] for _, s, e, v in secrets.candidates(text, secrets.base_spans(text)) if v == text[s:e]]

    for value in (key, jwt, long, long[:200], long[:201], long[:250] + "." + long[250:300]):
        for text in (value, f"x {value} y", f"It is {value}.", f"It is {value}...\nNext.", f"({value}), ...{value[:0]}"):
            assert values(text) == [value]
    assert values(f"{'a' * 400}.{key}") == [key] and values(f"{KEY}.{key}") == [key]
    assert values("short.aB3 and plain.words.with.dots.and.nothing.else " + "A" * 50_000 + ".") == []


def test_secrets_of_documents(spark, documents, small, sf_dir):
    rows = {r.doc_id: r for r in QUERIES["op3_secret_scan"](spark, sf_dir).collect()}
    for i, text in small:
        base = plain.secrets(text)
        assert rows[i].base_sha256 == plain.sha(",".join(base))
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
        assert set(base) <= set(rows[i].spans.split(",")) | {""}


def test_verdicts_of_documents(spark, documents, sf_dir):
    """All spans and verdicts of the query, and of rows with keys that owners share or don't."""
    rows = [(r.doc_id, r.text, r.source) for r in documents.select("doc_id", "text", "source").collect()]
    found = {r.doc_id: (r.spans, r.n_live, r.n_example) for r in QUERIES["op3_secret_scan"](spark, sf_dir).collect()}
    assert found == plain.spans_of_secrets(rows)
    r = random.Random(3)
    keys = ["".join(r.choices("abcdefghijkLMNOPQRSTUVWXYZ0123456789", k=n)) for n in (20, 24, 40, 300)]
    made = [(i, " ".join(r.choice([f"token={k}", f"see {k}.", f"{k}.{keys[0]}", "plain words", f"api_key: '{k[:8]}'", f"Secret = \"{k}\""]) for k in r.sample(keys, 2)), r.choice(["a", "b", "c", None])) for i in range(60)]
    made += [(100 + i, f"only here {r.randint(0, 9)}{keys[1][::-1]} x", "a") for i in range(3)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(3)
    told = {r.doc_id: (",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans), sum(s.verdict == "live" for s in r.spans), sum(s.verdict == "example" for s in r.spans)) for r in secrets.scan_secrets(df).collect()}
    assert told == plain.spans_of_secrets(made) and sum(x[1] for x in told.values()) > 3 and sum(x[2] for x in told.values()) > 10


def test_secrets_of_awkward_rows(awkward, nothing):
    assert secrets.scan_secrets(awkward).count() == len(AWKWARD) and secrets.scan_secrets(nothing).count() == 0


# --- the lattice ---


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces.load(sentencepiece_sampling.default_model())


def cuts(string, ids):
    """All segmentations."""
    if not string:
        return [[]]
    return [[ids[string[:n]], *rest] for n in range(1, len(string) + 1) if string[:n] in ids for rest in cuts(string[n:], ids)]


def plain_sums(string, pieces, chances):
    """Logarithms of the sums at all positions, byte by byte."""
    out = np.full((len(string) + 1, chances.shape[1]), -np.inf)
    out[0] = 0
    for j in range(1, len(string) + 1):
        found = [(i, pieces.ids[string[i:j]]) for i in range(max(0, j - pieces.widest), j) if string[i:j] in pieces.ids]
        with np.errstate(divide="ignore"):
            out[j] = np.logaddexp.reduce(out[[i for i, _ in found]] + np.log(chances[[x for _, x in found]]), axis=0)
    return out


def array(texts):
    return W.column_bytes(pa.array(texts, pa.string()))


def test_every_piece_is_found(pieces):
    strings = list(pieces.ids)
    assert pieces.widest == max(map(len, strings)) == 25 and b" " * 16 in pieces.ids
    for size in range(1, pieces.widest + 1):
        some = [s for s in strings if len(s) == size][:500]
        if some:
            found = pieces.cuts(np.frombuffer(b"".join(some), np.uint8).reshape(-1, size))[size - 1, size - 1]
            assert found.tolist() == [pieces.ids[s] for s in some]


UNSPACED = ["日本語テスト😀" * 30, "ไม่มีช่องว่าง" * 60, "x" * 1500, "Становништво" * 200, "qwertyuiopasdfgh" * 300, " " * 3000, "aB3" + "==" * 700, "한국어" * 700]


def in_bytes(text):
    data = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    return data, np.array([0]), np.array([len(data)])


@pytest.fixture(params=[(1024, 128, 1 << 15), (7, 32, 64), (40, 32, 32)])
def sizes(request, monkeypatch):
    for name, value in zip(("LONG", "SPAN", "STRETCH"), request.param, strict=True):
        monkeypatch.setattr(lattice, name, value)


def test_sums_over_all_segmentations(pieces, sizes):
    r = np.random.default_rng(0)
    chances = np.vstack([r.random((len(pieces.spelling), 3)) ** 4, np.zeros((1, 3))])
    for text in (b" the", b" Hello", b"\xe6\x97\xa5x", b" ation", b" mixed lengths"):
        expected = sum(np.prod(chances[c], axis=0) for c in cuts(text, pieces.ids))
        assert np.allclose(np.exp(plain_sums(text, pieces, chances)[-1]), expected)
        assert np.allclose(np.exp(lattice.log_sums(pieces, *in_bytes(text), chances)), expected)
    for text in UNSPACED:
        data, start, end = in_bytes(text)
        expected = plain_sums(data.tobytes(), pieces, chances)[-1]
        assert np.allclose(lattice.log_sums(pieces, data, start, end, chances, languages=2), expected)
        start, end = pieces.split(data, start, end)
        assert start[0] == 0 and end[-1] == len(data) and (start[1:] == end[:-1]).all()
        assert np.allclose(lattice.log_sums(pieces, data, start, end, chances).sum(axis=0), expected)


def test_rare_bytes_do_not_underflow(pieces):
    chances = np.append(np.where([bool(x) for x in pieces.spelling], 1e-9, 0), 0.0)[:, None]
    for size in (32, 1000, 5000):
        data, start, end = in_bytes(bytes(range(128, 256)) * (size // 32))
        found = lattice.log_sums(pieces, data, start, end, chances)[0, 0]
        assert np.isclose(found, plain_sums(data.tobytes(), pieces, chances)[-1, 0]) and np.isfinite(found)


def test_places_that_no_piece_reaches_across(pieces):
    text = " Hello日本語の文章 and_some_code(x)Становништвоไม่มี" * 3 + "\n"
    data, start, end = in_bytes(text)
    string, free = data.tobytes(), [0]
    for b in range(1, len(string)):
        if not any(string[i:j] in pieces.ids for i in range(max(0, b - pieces.widest), b) for j in range(b + 1, min(len(string), i + pieces.widest) + 1)):
            free.append(b)
    assert pieces.split(data, start, end)[0].tolist() == free
    two = np.concatenate([data, data[:10], data])
    opens, closes = np.array([0, len(data), len(data) + 10]), np.array([len(data), len(data) + 10, 2 * len(data) + 10])
    assert pieces.split(two, opens, closes)[0].tolist() == [*free, len(data), *(len(data) + 10 + x for x in free)]


def test_samples_follow_the_chances(pieces):
    chances, string, n = sentencepiece_sampling.rank_chances(pieces, 0.2), b" there", 60_000
    data = np.frombuffer(string * n, np.uint8)
    start = np.arange(n) * len(string)
    counts, ids = lattice.sample(pieces, chances, data, start, start + len(string), np.full(n, 5, np.uint64), np.arange(n))
    ends = np.cumsum(counts)
    seen: dict = {}
    for a, b in zip(ends - counts, ends, strict=True):
        seen[tuple(ids[a:b])] = seen.get(tuple(ids[a:b]), 0) + 1
    weights = {tuple(c): float(np.prod(chances[c, 0])) for c in cuts(string, pieces.ids)}
    total = sum(weights.values())
    assert set(seen) <= set(weights) and len(seen) > 8
    assert all(abs(seen.get(c, 0) / n - w / total) < 0.01 for c, w in weights.items())
    long = lattice.long_samples(pieces, chances, np.frombuffer(string, np.uint8), np.full(3000, 5, np.uint64), np.arange(3000))
    assert [tuple(x[::-1]) for x in long] == [tuple(ids[a:b]) for a, b in zip((ends - counts)[:3000], ends[:3000], strict=True)]


def test_samples_of_long_strings_follow_the_chances(pieces, sizes):
    """The first piece of a long string, and how often its cuts fall on each place, against the exact probabilities."""
    r, n = np.random.default_rng(7), 4000
    chances = np.append(r.random(len(pieces.spelling)) * [bool(x) for x in pieces.spelling], 0.0)[:, None]
    string = b"thereandthenothermanifestationsinthehouse"
    ahead, back = plain_sums(string, pieces, chances)[:, 0], np.array([plain_sums(string[i:], pieces, chances)[-1, 0] for i in range(len(string))] + [0.0])
    exact = np.exp(ahead + back - ahead[-1])
    counts, ids = lattice.sample(pieces, chances, np.frombuffer(string * n, np.uint8), np.arange(n) * len(string), (np.arange(n) + 1) * len(string), np.full(n, 3, np.uint64), np.arange(n))
    width, seen, at = np.array([len(x) for x in pieces.spelling]), np.zeros(len(string) + 1), 0
    for c in counts:
        places = np.concatenate([[0], np.cumsum(width[ids[at : at + c]])])
        assert places[-1] == len(string) and b"".join(pieces.spelling[i] for i in ids[at : at + c]) == string
        seen[places] += 1
        at += c
    assert np.abs(seen / n - exact).max() < 0.04


TEXTS = [*UNSPACED, "  two rows of spaces   ", " and next", "Hello  world\n x▁y\n\n", "", "日本語テスト😀 a" * 3, " ", "x" * 5000 + " " + "ab" * 500, "\n", "\x00\x7f tab\t", "▁▁"]


def test_encoding_is_lossless(pieces):
    coder = sentencepiece_sampling.Coder(pieces, 0.3)
    offsets, data = array(TEXTS)
    counts, ids = coder.encode(offsets, data, np.arange(len(TEXTS), dtype=np.uint64))
    ends = np.cumsum(counts)
    assert [coder.decode(ids[e - n : e].tolist()).decode() for e, n in zip(ends, counts, strict=True)] == TEXTS


def test_samples_against_plain_python(spark, documents, pieces, sf_dir):
    """The ids of the query, drawn again a string at a time."""
    import xxhash

    rows = {r.doc_id: r.ids for r in QUERIES["op2_sentencepiece_sampling"](spark, sf_dir).collect()}
    chance = sentencepiece_sampling.rank_chances(pieces)[:, 0]
    texts = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    texts = [x for x in texts if len(x[1] or "") < 3000][:80]
    assert len(texts) > 50
    for i, text in texts:
        first = xxhash.xxh64_intdigest((20).to_bytes(4, "little"), seed=42)
        seed = plain.mixed(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=first))
        assert rows[i] == plain.sampled(text, seed, pieces, chance)
    odd = [(i, x) for i, x in enumerate([*UNSPACED[:3], "  a  b\n\n c", "日本 " * 9, ""])]
    for r in sentencepiece_sampling.encode(frame(spark, odd), seed=20).collect():
        first = xxhash.xxh64_intdigest((20).to_bytes(4, "little"), seed=42)
        seed = plain.mixed(xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little"), seed=first))
        if max(map(len, (r.text or "").split(" "))) < 600:
            assert r.pieces.ids == plain.sampled(r.text, seed, pieces, chance)


def test_samples_are_reproducible(spark, documents):
    coded = lambda df, **options: {r.doc_id: r.pieces.ids for r in sentencepiece_sampling.encode(df, **options).collect()}
    docs = documents.select("doc_id", "text").limit(60).cache()
    once = coded(docs, seed=3)
    assert coded(docs.repartition(7), seed=3) == once
    other = coded(docs, seed=4)
    assert sum(other[i] != once[i] for i in once) > 50


def test_round_trip_of_awkward_rows(awkward, nothing):
    coded = sentencepiece_sampling.encode(awkward)
    assert coded.columns == [*awkward.columns, "pieces"]
    rows = sentencepiece_sampling.decode(coded.select("doc_id", "text", F.col("pieces.ids").alias("ids"), "pieces.lossless"), into="back").collect()
    assert len(rows) == len(AWKWARD) and all(r.back == (r.text or "") and r.lossless for r in rows)
    assert sentencepiece_sampling.encode(nothing).count() == 0


# --- language ID ---


def test_held_out_accuracy(spark, documents, sf_dir):
    rows = QUERIES["op4_language_id"](spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id").collect()
    unseen = [r for r in rows if r.held_out]
    assert unseen and sum(r.lang_pred == r.lang for r in unseen) / len(unseen) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_against_plain_python(spark, documents, pieces, tmp_path):
    """The whole result of the query: fitted and asked again a word at a time."""
    rows = [(r.doc_id, r.text, r.lang) for r in documents.select("doc_id", "text", "lang").collect() if len(r.text or "") < 900][:70]
    rows += [(10_000, "", "en"), (10_001, None, None), (10_002, "123 456", "de"), (10_003, "日本語 の 文章 と 日本", "ja"), (10_004, "日本 の 言葉", "ja"), (10_005, "文章 の 日本", None)]
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op4_language_id"](spark, str(tmp_path)).collect()}
    expected = plain.languages(rows, pieces.ids, sum(bool(x) for x in pieces.spelling))
    assert {i: x[0] for i, x in found.items()} == {i: x[0] for i, x in expected.items()}
    assert all(abs(found[i][1] - expected[i][1]) < 1e-5 for i in found)


def test_no_language_loses_its_words_to_larger_ones(spark):
    large = spark.range(320).select(F.lit("large").alias("lang"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("w"), (F.col("id") % 160 * 1000 + i).cast("string"))), " ").alias("text"))
    small = spark.createDataFrame([(f"l{i:03}", f"rare{i}") for i in range(205)], "lang string, text string")
    assert language_id.train(large.union(small)).languages == ["l" + f"{i:03}" for i in range(205)] + ["large"]


def test_training_does_not_depend_on_the_dealing(spark, documents):
    one, other = (language_id.train(documents.repartition(n)) for n in (2, 7))
    assert one.languages == other.languages and (one.chances == other.chances).all()


def test_expected_counts_are_sums_over_all_segmentations(pieces, sizes):
    chance = np.append(np.random.default_rng(5).random(len(pieces.spelling)) * [bool(x) for x in pieces.spelling], 0.0)
    for text in (" the", "日本", " manifest"):
        expected = np.zeros(len(chance) - 1)
        found = [(c, np.prod(chance[c])) for c in cuts(text.encode(), pieces.ids)]
        for c, p in found:
            np.add.at(expected, c, p / sum(x for _, x in found))
        told = lattice.expected(pieces, *in_bytes(text), np.array([3]), chance, 1 << 24)
        assert np.allclose(told / (1 << 24), 3 * expected, atol=1e-6)
        long = np.zeros(len(expected))
        for ids, weights in lattice.long_expected(pieces, in_bytes(text)[0], chance[:, None]):
            np.add.at(long, ids, weights)
        assert np.allclose(long, expected)


def test_expected_counts_cover_every_byte(pieces):
    chance = np.append(np.array([bool(x) for x in pieces.spelling]) / 32_000, 0.0)
    for text in UNSPACED:
        data, start, end = in_bytes(text)
        whole = lattice.expected(pieces, data, start, end, np.array([2]), chance, 1 << 24) / (1 << 24)
        assert np.isclose(whole @ [len(x) for x in pieces.spelling], 2 * len(data), rtol=1e-5)
        start, end = pieces.split(data, start, end)
        assert np.allclose(lattice.expected(pieces, data, start, end, np.full(len(start), 2), chance, 1 << 24) / (1 << 24), whole, rtol=1e-4, atol=1e-3)


def test_text_without_spaces_costs_about_as_much_as_with(pieces):
    import time

    coder, r, costs = sentencepiece_sampling.Coder(pieces), np.random.default_rng(1), []
    letters = r.integers(97, 123, 400_000).astype(np.uint8)
    spaced = letters.copy()
    spaced[::7] = 32
    for data in (spaced, letters):
        began = time.perf_counter()
        coder.encode(np.array([0, len(data)]), data, np.ones(1, np.uint64))
        costs.append(time.perf_counter() - began)
    assert costs[1] < 5 * costs[0]


def test_a_language_of_whole_clauses(spark):
    """Sixty ideographs without a space in each document."""
    r = random.Random(2)
    zh = ["".join(chr(r.randint(0x4E00, 0x5000)) for _ in range(60)) for _ in range(200)]
    en = [" ".join(r.choice(("the", "house", "of", "many", "words", "stands")) for _ in range(12)) for _ in range(200)]
    docs = spark.createDataFrame([("zh", x) for x in zh] + [("en", x) for x in en], "lang string, text string").repartition(4)
    model = language_id.train(docs)
    assert model.languages == ["en", "zh"]
    assert all(r.language.lang == r.lang for r in language_id.identify(docs, model).collect())


def test_languages_without_spaces_are_learned(spark):
    ja, zh = "日本語の文章は単語の間に空白を置かないので一つの文がとても長い単語になる。", "中文的句子在词与词之间没有空格所以整个分句就是一个很长的词语。"
    docs = spark.createDataFrame([("ja", ja), ("zh", zh), ("en", "words with spaces between them")], "lang string, text string")
    model = language_id.train(docs)
    assert model.languages == ["en", "ja", "zh"]
    assert all(r.language.lang == r.lang for r in language_id.identify(docs, model).collect())


def test_held_out_rows(spark):
    import zlib

    rows = spark.range(200).select("id", language_id.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_scores_are_sums_over_all_segmentations(spark, documents, pieces):
    model = language_id.train(documents)
    offsets, data = array(["the und"])
    expected = sum(np.log(sum(np.prod(model.chances[c], axis=0) for c in cuts(w, pieces.ids))) for w in (b" the", b" und"))
    assert np.allclose(model.scores(offsets, data)[0], expected)


def test_languages_of_awkward_rows(documents, awkward, nothing):
    model = language_id.train(documents)
    found = language_id.identify(awkward, model)
    assert found.columns == [*awkward.columns, "language"]
    told = {(r.doc_id, r.text): r.language for r in found.collect()}
    for i, text in AWKWARD:
        assert (told[i, text].lang == "und") == (not any(c.isalpha() for c in text or ""))
    assert language_id.identify(nothing, model).count() == 0
    empty = language_id.train(nothing)
    assert {r.language.lang for r in language_id.identify(awkward, empty).collect()} == {"und"}


# --- pseudonyms ---


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def replaced(spark, texts, key="k"):
    rows = pseudonyms.pseudonymise(frame(spark, list(enumerate(texts))), key).collect()
    found = {r.doc_id: r.pseudonyms.text for r in rows}
    return [found[i] for i in range(len(texts))]


def test_formats_stay_and_values_stay_linked(spark):
    texts = ["+1 (469) 555-8958", "(469) 555-8958", "4944339490429605", "4944 3394 9042 9605", "a.b7@mail.example.com", "61.131.143.218", "123-45-6789", "2021-02-28", "02/28/2021", "28/02/2021", "28.02.2021", "2021/02/28", "+49 30 1234567"]
    new = replaced(spark, texts)
    shape = lambda x: re.sub("[0-9]", "0", re.sub("[a-z]", "a", x))
    for old, made in zip(texts, new, strict=True):
        assert made != old and (shape(made) == shape(old) or old.count(".") == 3)
    assert new[0] == "+1 " + new[1] and new[2] == new[3].replace(" ", "") and luhn(new[2])
    year, month, day = new[7].split("-")
    assert new[8:12] == [f"{month}/{day}/{year}", new[9], f"{day}.{month}.{year}", f"{year}/{month}/{day}"]
    assert new[9] == f"{day}/{month}/{year}"
    assert replaced(spark, [f"call {t} now" for t in texts]) == [f"call {x} now" for x in new]
    assert replaced(spark, texts, "other") != new


def test_invalid_values_stay(spark):
    texts = ["4944339490429606", "999.1.1.1", "000-12-3456", "666-12-3456", "2021-02-30", "13/13/2021", "1.2.3.4.5", "123456", "12:30", "v1.2.3", "", None, "no digits", "x4944339490429605"]
    assert replaced(spark, texts) == texts


def test_permutations(spark):
    """Every value of a small format has its own image in it."""
    days = spark.range(146_097).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    made = days.select(pseudonyms.new_date(F.col("d"), "k").alias("d")).distinct()
    assert made.count() == 146_097 and made.agg(F.min("d"), F.max("d")).first()[:] == ("1800-01-01", "2199-12-31")
    grid = spark.range(1000).select(F.array((F.col("id") % 10).cast("int"), (F.col("id") / 10 % 10).cast("int"), (F.col("id") / 100).cast("int")).alias("v"))
    assert grid.select(pseudonyms.feistel(F.col("v"), F.array(*[F.lit(10)] * 3), "k", F.lit("t")).alias("v")).distinct().count() == 1000
    ssn = spark.range(20_000).select(F.format_string("%03d-%02d-%04d", F.lit(665) + 2 * (F.col("id") % 2), 1 + F.col("id") % 99, 1 + F.col("id") % 9999).alias("s")).distinct()
    new = ssn.select(pseudonyms.new_ssn(F.col("s"), "k").alias("s"))
    assert new.distinct().count() == ssn.count() and new.where(r"s not rlike '^(?!000|666|9)\\d{3}-(?!00)\\d{2}-(?!0000)\\d{4}$'").count() == 0


def test_feistel_by_hand(spark):
    """The rounds restated in Python."""
    import hashlib

    import xxhash

    def by_hand(values, radixes, key, tweak):
        values = list(values)
        for turn in range(pseudonyms.ROUNDS):
            others = ",".join(str(x) for i, x in enumerate(values) if i % 2 != turn % 2)
            seed = hashlib.sha256(f"{key}|{tweak}|{turn}|{others}".encode()).hexdigest()
            for i in range(turn % 2, len(values), 2):
                first = xxhash.xxh64_intdigest(seed.encode(), seed=42)
                stream = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=first)
                stream -= (stream >> 63) << 64
                values[i] = (values[i] + stream % radixes[i]) % radixes[i]
        return values

    values, radixes = [3, 1, 4, 1, 5, 9, 2], [10, 10, 26, 7, 10, 256, 3]
    df = spark.createDataFrame([(values, radixes)], "v array<int>, r array<int>")
    assert df.select(pseudonyms.feistel(F.col("v"), F.col("r"), "key", F.lit("tweak")).alias("x")).first().x == by_hand(values, radixes, "key", "tweak")


def test_pseudonyms_against_plain_python(spark, documents, small, sf_dir):
    """Whole texts and all counts of the query, and of texts full of edges."""
    for r in QUERIES["op9_pseudonyms"](spark, sf_dir).collect():
        text = dict(small)[r.doc_id]
        expected, counts = plain.pseudonyms(text, "leafmill-test-key")
        assert r.text == expected and [r[f"n_{kind}"] for kind in plain.PRIVATE] == [counts[kind] for kind in plain.PRIVATE]
    r, parts = random.Random(5), ["4944339490429605", "4944 3394 9042 9605", "3782-822463-10005", "378282246310005", "(469) 555-8958", "+1 469.555.8958", "+49 30 1234567", "+442079460958", "a.B7+x@m-1.example.com", "é@x.de"]
    parts += ["2021-02-28", "2021-02-29", "28/02/2021", "02/28/2021", "05/06/1999", "31.12.9799", "1000/01/01", "0999-12-31", "123-45-6789", "666-12-3456", "899-99-9999", "61.131.143.218", "256.1.1.1", "1.2.3.4.5", "日本", "x", "-", "7", "(123) 555-1234", "200-300-4000"]
    docs = [(i, "".join(r.choice(parts) + r.choice([" ", ", ", "\n", "", ".", "/", "é"]) for _ in range(12))) for i in range(150)]
    for row in pseudonyms.pseudonymise(frame(spark, docs), "k").collect():
        assert row.pseudonyms.text == plain.pseudonyms(row.text, "k")[0]


def test_pseudonyms_of_awkward_rows(awkward, nothing):
    found = pseudonyms.pseudonymise(awkward, "k")
    assert found.columns == [*awkward.columns, "pseudonyms"]
    assert all(r.pseudonyms.text == r.text for r in found.collect()) and found.count() == len(AWKWARD)
    assert pseudonyms.pseudonymise(nothing, "k").count() == 0


def test_private_values_of_documents_go(spark, documents, sf_dir):
    old = {r.doc_id: r.text for r in documents.collect()}
    find = lambda t: set(re.findall(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b", t))
    for r in QUERIES["op9_pseudonyms"](spark, sf_dir).collect():
        before = {x for x in find(old[r.doc_id]) if not re.fullmatch(r"\d{16}", x) or luhn(x)}
        assert not before & find(r.text)


# --- quotations ---

TALK = [
    (1, 0, "user", "Hello there.\n\nHow are  you?"), (1, 1, "assistant", "Fine thanks.\nAnd you?"), (1, 2, "user", "ok good"),
    (1, 3, "assistant", "On Monday Bob wrote:\n> fine thanks.\n> And you?\nI answer that"), (1, 4, "user", "continuing"), (1, 5, "assistant", "> > How are you?\n> Fine thanks.\n\ndeep"),
    (1, 6, "user", "> continuing\nyes"), (1, 7, "user", "> nobody said this\nhm"), (2, 0, "user", "> ok good\nfrom elsewhere"), (None, 1, "user", "x"), (2, None, "user", "y"), (2, 1, None, None), (2, 1, None, None),
]


def test_reply_order(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumn("branch", F.lit(None).cast("int")).repartition(3)
    rows = sorted(quotations.reply_ordered(df).collect(), key=lambda r: (r.conv_id is None, r.conv_id, r.part is None, r.branch_rank))
    found = [(r.conv_id, r.branch, [(m.turn, m.reply_to, m.text) for m in r.messages], r.n_quotes, r.n_linked) for r in rows]
    assert found == [
        (1, None, [(0, None, TALK[0][3]), (1, 0, TALK[1][3]), (2, 1, "ok good")], 0, 0),
        (1, 3, [(3, 1, "I answer that"), (4, 3, "continuing")], 1, 1),
        (1, 6, [(6, 4, "yes"), (7, 6, "hm")], 2, 1),
        (1, 5, [(5, 1, "deep")], 2, 2),
        (2, None, [(0, None, "from elsewhere"), (1, 0, "")], 1, 1),
        (2, None, [(None, None, "y")], 0, 0),
        (None, None, [(1, None, "x")], 0, 0),
    ]
    assert [s.conv for r in rows for m in r.messages for s in m.sources if r.conv_id == 2] == [1]


def test_a_passage_that_its_own_conversation_repeats_later_is_linked_elsewhere(spark):
    rows = [(1, 0, "user", "> said elsewhere\nwhat of it"), (1, 1, "user", "said elsewhere"), (3, 2, "user", "said elsewhere"), (2, 5, "user", "said elsewhere"), (2, 4, "user", "> said elsewhere\nx"), (None, 1, "user", "> said elsewhere\ny")]
    found = quotations.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    told = {(r.conv_id, m.turn): [(s.conv, s.turn) for s in m.sources] for r in found for m in r.messages}
    assert told[1, 0] == [(2, 5)] and told[2, 4] == [(1, 1)] and told[None, 1] == [(None, None)]


def depth_first(parents):
    children = {}
    for turn, parent in sorted(parents.items()):
        children.setdefault(parent, []).append(turn)
    order, stack = [], children.get(None, [])[::-1]
    while stack:
        order.append(stack.pop())
        stack += children.get(order[-1], [])[::-1]
    return order


@pytest.mark.parametrize("bucket", [4096, 5])
def test_reply_order_is_depth_first(spark, monkeypatch, bucket):
    monkeypatch.setattr(quotations, "BUCKET", bucket)
    r, rows, parents = random.Random(6), [], {}
    for conv, size in ((1, 40), (2, 25), (3, 1)):
        for turn in range(size):
            answers = r.randrange(turn) if turn and r.random() < 0.4 else turn - 1 if turn else None
            quote = f"> unique words {conv} {answers}\n" if answers is not None and answers != turn - 1 else ""
            rows.append((conv, turn, "user", f"{quote}unique words {conv} {turn}"))
            parents.setdefault(conv, {})[turn] = answers
    found = quotations.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv, own in parents.items():
        mine = sorted((x for x in found if x.conv_id == conv), key=lambda x: (x.branch_rank, x.part))
        assert [m.turn for x in mine for m in x.messages] == depth_first(own)
        assert {m.turn: m.reply_to for x in mine for m in x.messages} == own


def test_many_messages_of_one_turn(spark, monkeypatch):
    monkeypatch.setattr(quotations, "BUCKET", 5)
    rows = [(1, 0, "user", f"text {i}") for i in range(60)] + [(1, 1, "user", "> text 7\nlast")]
    found = quotations.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(m.text for r in found for m in r.messages) == sorted([f"text {i}" for i in range(60)] + ["last"])
    assert len({r.slice for r in found}) > 5 and max(len(r.messages) for r in found) < 20
    assert [(m.reply_to, m.sources[0].turn) for r in found for m in r.messages if m.text == "last"] == [(0, 0)]


def test_a_conversation_of_deep_branches(spark):
    """Each message answers another than the one before, so branches hang on branches, 300 deep; and one message has 200 answers."""
    rows = [(1, t, "user", (f"> unique words 1 {t - 2}\n" if t > 1 else "") + f"unique words 1 {t}") for t in range(300)]
    rows += [(2, t, "user", ("> unique words 2 0\n" if t > 1 else "") + f"unique words 2 {t}") for t in range(200)]
    found = quotations.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv in (1, 2):
        mine = sorted((x for x in found if x.conv_id == conv), key=lambda x: (x.branch_rank, x.part))
        parents = {t: (t - 2 if conv == 1 else 0) if t > 1 else t - 1 if t else None for t in range(300 if conv == 1 else 200)}
        assert sorted({x.branch_rank for x in mine}) == list(range(len({x.branch for x in mine})))
        assert {m.turn: m.reply_to for x in mine for m in x.messages} == parents
        told = {t: (own, order) for (c, t, _, _), (own, _, _, _, order) in plain.replies(rows).items() if c == conv}
        assert [m.turn for x in mine for m in x.messages] == sorted(told, key=lambda t: told[t][1])


def test_quotes_of_conversations_and_nothing(spark, sf_dir):
    """The whole query against the rules in plain Python."""
    talks = queries.quoting_conversations(spark, sf_dir)
    rows = [tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()]
    plain_rows = plain.replies(rows)
    found = sorted(QUERIES["op1_quotation_linking"](spark, sf_dir).collect(), key=lambda r: (r.conv_id, r.branch_rank, r.part))
    assert len(rows) == spark.read.parquet(f"{sf_dir}/conversations.parquet").count() == sum(len(r.messages) for r in found)
    told = [(r.conv_id, m.turn, m.role, m.text, m.reply_to, [(s.passage, s.level, s.conv, s.turn) for s in m.sources], r.branch) for r in found for m in r.messages]
    expected = [(c, t, role, own, answers, sources, None if branch is None else branch) for (c, t, role, _), (own, answers, sources, branch, order) in sorted(plain_rows.items(), key=lambda x: (x[0][0], x[1][4]))]
    assert told == expected
    sources = [s for *_, x, _ in told for s in x]
    assert sum(s[3] is not None for s in sources) > 0.8 * len(sources) > 20 and any(s[2] != r[0] and s[2] is not None for r in told for s in r[5])
    assert quotations.reply_ordered(talks.limit(0)).count() == 0


def test_levels():
    own, units, passages = quotations.parse("Hi\n\nAm 3. Mai schrieb Eva:\n> > a\n>b\n> c\n\nmine\nOn it: he wrote nothing:\nend")
    assert own == "Hi\n\n\nmine\nOn it: he wrote nothing:\nend" and passages == [(2, ["a"]), (1, ["b", "c"])]
    assert "mine on it: he wrote nothing: end" in units and "hi" in units


