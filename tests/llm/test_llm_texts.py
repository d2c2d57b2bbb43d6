"""The operators on documents against brute force, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from parley.llm import decontaminate, fuzzylines, jaccard, packing, planes, recompress, rules, words

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("texts_", [[], [""], [None, "a"], ["a b", " c", "", "d\te\n"], ["é x", "x", "\x1cy z"]])
def test_words(texts_):
    got = words.split(pa.array(texts_, pa.string()))
    found = [[bytes(got.data[s:e]).decode() for s, e in zip(got.starts[a:b], got.ends[a:b])] for a, b in zip(got.first, got.first[1:])]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts_]
    by_word = dict(zip(sum(found, []), got.hashes().tolist()))
    assert [by_word[w] for w in sum(found, [])] == got.hashes().tolist() and len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("vocab", [200, 49_408, 2**20])
def test_planes_round_trip(bits, vocab):
    import io

    rng = np.random.default_rng(1)
    docs_ = [(k if k else None, rng.integers(0, vocab, n).astype(np.uint32)) for k, n in enumerate([0, 1, 5, 1000, 63, 64, 65, 0])]
    out = io.BytesIO()
    writer = planes.ShardWriter(out, vocab, block=64, bits=bits)
    for doc in docs_:
        writer.add(*doc)
    writer.close()
    source = pa.BufferReader(out.getvalue())
    reader = planes.ShardReader(source)
    got = [(d, s, np.concatenate([*p, np.zeros(0, np.uint32)])) for d, s, p in reader.documents()]
    assert [d for d, *_ in got] == [d for d, _ in docs_]
    assert all((a == b).all() for (_, _, a), (_, b) in zip(got, docs_))
    assert [s for _, s, _ in got] == np.cumsum([0] + [len(x) for _, x in docs_])[:-1].tolist()
    with pytest.raises(ValueError):
        planes.ShardWriter(io.BytesIO(), 256).add(1, np.array([256], np.uint32))


def test_token_shards_match_the_tokenizer(spark, docs, texts, edge_docs, no_docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in planes.token_shards(docs, path, 49_408, 1, block=1000).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    odd = planes.token_shards(edge_docs, path, 49_408, 1).collect()
    assert len(odd) == 11 and min(odd, key=lambda r: r.start).doc_id is None and sum(r.n_tokens == 1 for r in odd) == 3
    assert planes.token_shards(no_docs, path, 49_408, 1).count() == 0
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert planes.drops_blanks(path) and not planes.drops_blanks(other)
    whole = Tokenizer.from_file(other)
    got = {r.doc_id: r for r in planes.token_shards(docs, other, 50_257, 1, folder=str(tmp_path)).collect()}
    for doc_id, text in texts.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[doc_id].n_tokens, got[doc_id].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert planes.qualified(spark, "/a/b c") == "file:///a/b c" and planes.qualified(spark, "file:///a") == "file:///a"
    assert planes.memo_encoder(path)([b"<|ENDOFTEXT|> <|endoftext|>x A\x1cB"])[0] == np.array(tokenizer.encode("<|ENDOFTEXT|> <|endoftext|>x A\x1cB", add_special_tokens=False).ids, "<u4").tobytes()


def repeats(rows, window):
    seen, out = set(), {}
    for doc_id, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for k in range(len(found) - window + 1):
            key = tuple(found[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        kept = " ".join(w for k, w in enumerate(found) if k not in gone)
        out[doc_id] = (len(found), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [5, 20, 33])
def test_recompression_finds_all_repeats(spark, window):
    """Few words, runs and periods: the worst case for parsing."""
    rng = np.random.default_rng(window)
    rows = []
    for k in range(60):
        parts = [" ".join(rng.choice(list("abc"), 30)), "x " * int(rng.integers(0, 90)), "Is onhe. " * int(rng.integers(0, 60)), " ".join(rng.choice(list("abcdefgh"), 80))]
        rows.append((k, " ".join(parts[i] for i in rng.permutation(4))))
    rows += [(100 + k, rows[k][1][7:] + " end") for k in range(20)]
    got = recompress.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == repeats(rows, window)


def test_recompression_tells_windows_of_a_frequent_symbol_apart():
    """400,000 different windows around one passage: 32 bits would take some of them for equal."""
    passage = "of the people and by the people in a town near the old river with its"
    texts = [f"{k} x{k % 977} {passage} y{k % 1009} z{k}" for k in range(400_000)]
    ids = np.arange(len(texts))
    batch = pa.RecordBatch.from_pydict({"doc": ids, "tie": ids, "text": texts})
    out = list(recompress._find(20, 1)([batch]))
    keys = np.concatenate([recompress._unpack(x.column("blob")[0].as_py())[1] for x in out])
    assert all(x.column("bucket")[0].as_py() == 0 for x in out) and np.unique(keys, return_counts=True)[1].max() > 200_000
    assert recompress.settle([x.column("blob")[0].as_py() for x in out]) is None


def test_recompression_odd_rows(spark, edge_docs, no_docs):
    got = sorted(recompress.drop_repeats(edge_docs, 3).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert len(got) == 11 and sum(r.n_words == 0 for r in got) == 3
    assert {(r.doc_id, r.n_removed) for r in got if r.doc_id in (1, 5)} == {(1, 0), (5, 10)}
    assert [r.kept_text for r in got if r.doc_id == 8] == ["long end"]
    assert recompress.drop_repeats(no_docs).count() == 0


def shingles(text, length):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[k : k + length]) for k in range(max(1, len(found) - length + 1))} if found else set()


@pytest.mark.parametrize("small,side", [(32, 256), (2, 4)])
def test_jaccard_join_is_exact(spark, texts, small, side):
    rng = np.random.default_rng(3)
    rows = sorted(texts.items())
    base = [t.split() for _, t in rows if 300 < len(t) < 900][:5]
    for k in range(60):  # near copies on both sides of the threshold
        copy = list(base[k % 5])
        for at in rng.choice(len(copy), int(rng.integers(0, 5)), replace=False):
            copy[at] = f"w{k}"
        rows.append((5000 + k, " ".join(copy)))
    sets = {i: shingles(t, 4) for i, t in rows}
    ids = [i for i, s in sets.items() if s]
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(sets, edges)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85, small, side).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_odd_rows(spark, edge_docs, no_docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(edge_docs).collect()}
    assert {(1, 6, 1), (5, 6, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (6, 1, 6)} <= got
    kept = jaccard.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, None, 6, 7, 8, 9])
    assert jaccard.join(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("small", [32, 2])
def test_fuzzy_lines(spark, docs, texts, small):
    lines = [(i, k, x.strip()) for i, t in sorted(texts.items()) for k, x in enumerate((t or "").split("\n")) if x.strip()]
    grams = {x: {x[k : k + 5] for k in range(len(x) - 4)} or {x} for *_, x in lines}
    names = sorted(grams)
    edges = [
        (a, b)
        for n, a in enumerate(names)
        for b in names[:n]
        if 0.8 <= len(grams[a]) / len(grams[b]) <= 1.25 and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])
    ]
    group, seen, gone = components(names, edges), set(), set()
    for i, k, x in lines:
        if group[x] in seen:
            gone.add((i, k))
        seen.add(group[x])
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}
    got = fuzzylines.drop_similar_lines(docs, small=small)
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_fuzzy_lines_odd_rows(spark, edge_docs, no_docs):
    got = fuzzylines.drop_similar_lines(edge_docs)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 11 and rows[2].text is None and rows[2].n_lines == 0 and rows[4].text == " \n\t \n"
    assert rows[5].text == "" and rows[6].text == "x" and rows[9].text == "A THIRD ONE!!! | with | bars"
    assert rows[7].text == "Été à l'œuvre — naïve façade\nsecond line here, quite long\n" and rows[7].component == "a"
    left = fuzzylines.drop_similar_lines(edge_docs, keep_empty=False)
    assert {r.doc_id for r in left.collect()} == {1, 2, 3, 4, None, 6, 7, 8, 9}
    assert fuzzylines.drop_similar_lines(no_docs).count() == 0


def test_fuzzy_lines_of_some_70_characters(spark):
    """Pairs around the length where signatures change: each is found, short with long too."""
    rng = np.random.default_rng(67)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    rows, pairs = [], 0
    for k in range(600):
        short = "x" + "".join(rng.choice(letters, 65)) + "x"
        longer = short[:30] + "q" * (k % 2) + short[30:] + "".join(rng.choice(letters[:26], 1 + k % 9))
        longer = longer if k % 3 else longer + "y" * 60  # many repeats, few different shingles
        a, b = ({x[j : j + 5] for j in range(len(x) - 4)} for x in (short, longer))
        assert len(short) == 67 and len(longer) > 67
        pairs += 100 * len(a & b) >= 80 * len(a | b)
        rows += [(2 * k, short), (2 * k + 1, longer)]
    removed = fuzzylines.drop_similar_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0")
    got = {r.doc_id for r in removed.collect()}
    assert pairs > 300 and all(d % 2 for d in got) and pairs - 3 <= len(got) <= pairs


def test_fuzzy_lines_of_odd_bytes():
    """Blanks at the ends, more than are passed one by one, breaks alone, and characters of several bytes."""
    texts_ = [" a\tb \n\n" + " " * 99 + "naïve œuvre" + "\t" * 99 + "\n" + " " * 99, None, "", "\n", "x" * 8 + "\n" + "x" * 16, "ab\x00", "ab", "\u2003 x"]
    want = [(i, k, x.strip(" \t\n\r\v\f")) for i, t in enumerate(texts_) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\v\f")]
    lines = fuzzylines.Lines(pa.array(texts_, pa.string()))
    found = [bytes(lines.data[a:b]).decode() for a, b in zip(lines.starts, lines.ends)]
    assert list(zip(lines.text.tolist(), lines.number.tolist(), found)) == want
    assert len(set(lines.hashes().tolist())) == len(set(found)) == len(found)
    alone = [fuzzylines.Lines(pa.array([f"\n {x} "])).hashes()[0] for x in found]
    assert alone == lines.hashes().tolist()
    first, chars = lines.code_points(np.arange(len(found)))
    assert ["".join(map(chr, chars[a:b])) for a, b in zip(first, first[1:])] == found


def test_fuzzy_lines_go_out_in_one_batch_a_slice(texts):
    """Bands of all buckets and places of all lines come together, and give each line's place back."""
    rows = {i: t for i, t in texts.items() if t}
    batch = pa.RecordBatch.from_pydict({"doc": list(rows), "tie": list(rows), "text": list(rows.values())})
    parts = list(words.slices([batch], "text", 1 << 20))
    out = list(fuzzylines._bands(64, 80)([batch]))
    assert len(out) == len(parts) and all(x.column("bucket").to_pylist()[-1] == -1 for x in out)
    met = pa.Table.from_batches(fuzzylines._join_bands(32)(out)).filter(pa.compute.field("node").is_valid())
    want = {(i, k) for i, t in rows.items() for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\v\f")}
    assert set(zip(met["doc"].to_pylist(), met["line"].to_pylist())) == want and met["tie"] == met["doc"] and len(met) == len(want)


def test_fuzzy_lines_are_taken_out_by_spark(spark, edge_docs):
    plan = fuzzylines.drop_similar_lines(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan


def test_decontamination_finds_copies_and_paraphrases(spark, docs, texts):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rng = np.random.default_rng(9)
    hosts = [t for t in texts.values() if 2000 < len(t) < 5000]
    rows, planted = list(texts.items()), set()
    for k, (item, text) in enumerate(sorted(items.items())):
        found = text.split()
        n = decontaminate.last_sentence(text)
        for at in rng.choice(max(1, len(found) - n), int(0.25 * len(found) * (k % 2)), replace=False):  # reworded, but for the answer
            found[at] = "other"
        host = hosts[k % len(hosts)].split()
        rows.append((7000 + k, " ".join(host[:50] + found + host[50:])))
        planted.add((7000 + k, item))
    for rank in (16, 64):
        got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, rank=rank, block=16)
        found = {(r.doc_id, r.item_id) for r in got.collect()}
        assert len(planted - found) <= 1
    exact = {(d, i) for i, t in items.items() for d, x in rows if t in x}
    assert exact <= found


def test_decontamination_keeps_clean_documents(spark, docs, texts):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = [r.text for r in bench.collect()]
    kept = decontaminate.drop_contaminated(docs, bench)
    gone = set(texts) - {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    assert gone >= {d for d, x in texts.items() if any(t in x for t in items)}
    plain = lambda t: re.findall(r"\w+", t.lower())
    for d in gone:  # each has most words of some item
        have = Counter(plain(texts[d]))
        assert any(sum((Counter(plain(t)) & have).values()) >= 0.6 * len(plain(t)) for t in items)


def test_decontamination_odd_rows(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "three four five six seven eight"), (2, None), (3, ""), (None, "naïve façade second line here")], "item_id long, text string")
    got = decontaminate.contaminated(edge_docs, bench)
    assert {(r.doc_id, r.item_id, r.kind) for r in got.collect()} == {(1, 1, "copy"), (5, 1, "copy"), (7, None, "copy")}
    assert decontaminate.contaminated(no_docs, bench).count() == 0
    assert decontaminate.drop_contaminated(edge_docs, bench.limit(0)).count() == 11


def slow_best_fit(sizes, masks, capacity):
    bins, out = [], []
    for size, mask in zip(sizes, masks):
        fits = [(room, k) for k, (room, held) in enumerate(bins) if room >= size and not held & mask]
        if fits:
            _, k = min(fits)
        else:
            bins.append((capacity, 0))
            k = len(bins) - 1
        bins[k] = (bins[k][0] - size, bins[k][1] | mask)
        out.append(k)
    return out


def test_best_fit_takes_the_tightest_bin():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(0, 40, 200).tolist()
        masks = packing.masks_of([None if x == 9 else f"s{x}" for x in rng.integers(0, 10, 200)], rng.integers(0, 150, 200).tolist())
        assert packing.best_fit(sizes, masks, 50) == slow_best_fit(sizes, masks, 50)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_bins_hold_all_words_without_conflicts(spark, docs, texts, capacity):
    rows = packing.pack(docs, capacity, shard_rows=64).collect()
    assert Counter({d: len(t.split()) for d, t in texts.items()}) == sum((Counter({r.doc_id: r.n_words}) for r in rows), Counter())
    bins = {}
    for r in sorted(rows, key=lambda r: (r.shard, r.bin, r.slot)):
        bins.setdefault((r.shard, r.bin), []).append(r)
    for held in bins.values():
        assert sum(r.n_words for r in held) == capacity - held[0].room_left <= capacity
        assert [r.start for r in held] == np.cumsum([0] + [r.n_words for r in held])[:-1].tolist()
        assert len({r.source for r in held}) == len(held) == len({r.cluster for r in held})


def test_bins_do_not_depend_on_the_layout(spark, edge_docs):
    rows = edge_docs.select("doc_id", "text", "source").collect()
    rows = [*rows, *rows, (5, "ONE TWO", "a"), (5, "one two", "a"), (5, "one two", None)] + [(77, "same text", "s")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: tuple((x is not None, x) for x in r)
    one, two = (sorted(packing.pack(d, 64, shard_rows=8).collect(), key=key) for d in (df.coalesce(1), df.orderBy(F.xxhash64("text", "doc_id")).repartition(7)))
    assert one == two and len(one) > 63
    copies = packing.numbered(df.repartition(5), ["doc_id", "text"]).where("doc_id = 77").select("copy").collect()
    assert sorted(r["copy"] for r in copies) == list(range(40))


def test_bins_odd_rows(spark, edge_docs, no_docs):
    rows = packing.pack(edge_docs).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter([1, 2, 3, 4, 5, 5, None, 6, 7, 8, 9])
    assert sum(r.n_words for r in rows if r.doc_id == 8) == 30_001
    assert packing.pack(no_docs).count() == 0


def test_rules_learn_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = rules.quality_scores(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    for r in got.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.93 * len(held)
    kept = rules.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_rules_odd_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    assert rules.quality_scores(edge_docs, labels).count() == 11
    only = labels.where("quality = 1")
    assert {r.score > 0.5 for r in rules.quality_scores(edge_docs, only).collect()} == {True}
    assert {r.score for r in rules.quality_scores(edge_docs, labels.limit(0)).collect()} == {0.5}
    assert rules.quality_scores(no_docs, labels).count() == 0
    assert rules.keep_good(edge_docs, only).columns == edge_docs.columns


def test_statistics_match_plain_counts(texts):
    some = [*list(texts.values())[:50], "", None, "Ab ab ab! | é\n\nz"]
    got = rules.statistics(pa.array(some, pa.string()))
    for k, t in enumerate(some):
        t = t or ""
        found, size = re.findall(r"[^\x20\x09-\x0D]+", t), len(t.encode()) or 1
        n = len(found) or 1
        assert got["chars"][k] == len(t) and got["words"][k] == len(found)
        assert got["distinct"][k] == pytest.approx(len(set(found)) / n) and got["repeated"][k] == pytest.approx(sum(a == b for a, b in zip(found, found[1:])) / n)
        assert got["upper"][k] == pytest.approx(sum("A" <= c <= "Z" for c in t) / size) and got["marks"][k] == pytest.approx(sum(c in "!?" for c in t) / size)


def test_tree_rules():
    text = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 1.5)
   If (feature 0 <= 0.5)
    Predict: 0.0
   Else (feature 0 > 0.5)
    Predict: 1.0
  Else (feature 0 > 1.5)
   Predict: 1.0"""
    assert tree_paths(text) == [((0, "<=", 1.5),), ((0, "<=", 0.5),), ((0, "<=", 1.5), (0, ">", 0.5)), ((0, ">", 1.5),)]


def tree_paths(text):
    return rules.tree_rules(text)


def test_memo_encoder_keeps_pieces_that_come_again():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, memo, encoded = Tokenizer.from_file(path), planes.MemoEncoder(path, room=80), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            encoded.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    memo.tokenizer = Counting()
    for k in range(30):
        texts = [f"Often, often (x{k}) w{k}é! {k}<|endoftext|>{k} <|endoftext|> it'ś\x1cA b ² ǅ #{k}" + "".join(f" q{k}z{j}" for j in range(12)), ""]
        want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert memo([t.encode() for t in texts]) == want
    # Once, however often the room was full; and many pieces at a time.
    assert sum(t.split().count("often") for t in encoded) == 1 and len(encoded) < 150
    assert len(memo.known) + len(memo.past) <= 2 * 80
