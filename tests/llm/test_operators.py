"""Brute force, exact round trips and edge cases for the training-data operators."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import chat, decontaminate, jaccard, lines, packing, quality, rans, sharding, simhash, substrings, warc
from vellum.llm.common import Scratch
from vellum.llm.files import Ranges
from vellum.llm.tokens import CachedEncoder, tokenizer_path

WORDS = "the of and a in to Ünder x- y. zeta eta theta iota kappa".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(rng):
    """Copies, near copies, shared passages, empty and null texts, a long text, repeated rows and ids."""
    texts = [None, "", " \n\t ", "one", "The end.", prose(rng, 5000)]
    passage = prose(rng, 60)
    for i in range(25):
        texts.append(prose(rng, rng.randrange(1, 120)))
        if i % 3 == 0:
            texts += [texts[-1]] * 2
        if i % 4 == 0:
            texts.append(f"{prose(rng, 20)}\n{passage}\n{prose(rng, 20)}")
        if i % 5 == 0:
            texts.append("\n".join([prose(rng, 3)] * 4))
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return [*rows, rows[-1], (None, texts[7], "y"), (None, None, "y"), (3, "another text", "y")]


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(7))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def same(got, expected):
    assert Counter(got) == Counter(expected)


# 1


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.randrange(1, 40)
        hist = {n: rng.randrange(1, 9) for n in rng.sample(range(1, capacity + 1), rng.randrange(1, capacity + 1))}
        rooms = []  # one piece at a time
        for length in sorted(hist, reverse=True):
            for _ in range(hist[length]):
                fit = min((r for r in rooms if r >= length), default=None)
                rooms.append((capacity if fit is None else fit) - length)
                if fit is not None:
                    rooms.remove(fit)
        bins, seen = defaultdict(list), Counter()
        for length, first, count, sequence, offset in packing.plan(hist, capacity):
            assert first == seen[length]
            seen[length] += count
            for s in range(sequence, sequence + count):
                bins[s].append((offset, length))
        assert seen == Counter(hist)
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in p) for p in bins.values()) == sorted(rooms)


def test_capacity_tree():
    tree = packing.CapacityTree(10)
    for c in (3, 7):
        tree.put(c, True)
    assert [tree.tightest(n) for n in (1, 3, 4, 7, 8)] == [3, 3, 7, 7, None]


def test_packing(docs, rows, empty):
    path = tokenizer_path("word_bpe_49k.json")
    out = packing.pack_documents(docs, path, capacity=64, keep_ids=True).collect()
    t = CachedEncoder(path, False).tokenizer
    expected = []
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            data = np.array(ids[at : at + 64], dtype="<u4").tobytes()
            expected.append((i, k, at, len(data) // 4, zlib.crc32(data), data))
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in out], expected)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64
    assert packing.pack_documents(empty, path).count() == 0


def test_encoder_is_exact():
    rng = random.Random(2)
    parts = ["the", "Ünï", "don't", "12", "a\nb", " ", "  ", "\n", " ", "<|endoftext|>", "<|", "é", "日本", "!!", "\x1c", "\r\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(25))) for _ in range(400)]
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        e = CachedEncoder(tokenizer_path(name), spaced, cache=60)
        got = [ids.tolist() for i in range(0, 400, 40) for ids in e.encode_batch(texts[i : i + 40])]
        assert got == [e.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_is_exact_for_every_character(name, spaced):
    e = CachedEncoder(tokenizer_path(name), spaced)
    texts = [f"a{c}. {c}b, x{c}' \u00c3{c}\u00c9.; \u0130. ab\u0130," for c in map(chr, [*range(1, 0x3100), *range(0xF900, 0x10450)])]
    found = e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [x.tolist() for x in e.encode_batch(texts)] == [x.ids for x in found]


# 2


def base_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    cover = {k for i, g in enumerate(grams) if count[g] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_quality_base_columns(docs, rows, empty):
    trusted = docs.where("doc_id < 12").select("doc_id")
    out = quality.judge(docs, trusted)
    assert set(docs.columns) <= set(out.columns)
    names = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed"]
    same([tuple(r) for r in out.select(*names).collect()], [base_by_hand(t) for _, t, _ in rows])
    assert out.where("_base_failed AND _kept").count() == 0
    assert quality.judge(empty, empty).count() == 0
    plain = quality.judge(docs, trusted.limit(0))
    assert plain.where("_kept = _base_failed").count() == 0


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(3)
    good = [prose(rng, 120) for _ in range(60)]
    junk = [" ".join(f"{w}{rng.choice(['***', '$$$', '!!'])}" for w in prose(rng, 120).split()) for _ in range(15)]
    df = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    kept = {r.doc_id for r in quality.judge(df, df.where("doc_id < 30")).where("_kept").collect()}
    assert kept == set(range(60))


def test_quality_counts_all(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "c")], "doc_id long, text string")
    model = quality.fit(df, df.where("doc_id = 1"), buckets=64)
    counts = df.select(F.col("doc_id"), F.explode(quality.let(quality._hashes(quality._words("text")), lambda h: quality._buckets(h, 64))).alias("b"))
    raw = {b: (sum(x.doc_id == 1 for x in g), len(g)) for b, g in ((b, [x for x in counts.collect() if x.b == b]) for b in {x.b for x in counts.collect()})}
    assert sum(n for _, n in raw.values()) == 6 and model == quality.log_ratios(raw, 64)


def test_quality_scores_trusted_rows_out_of_sample(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(vocab[int(rng.paretovariate(0.4)) % 3000] for _ in range(200))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in quality.judge(df, df.where("doc_id < 40"), buckets=256).collect()}
    assert sum(not r._kept for r in out.values()) <= 1  # prose with and without a label alike
    buckets = quality.let(quality._hashes(quality._words("text")), lambda h: quality._buckets(h, 256))
    grams = {r.doc_id: Counter(r.b) for r in df.select("doc_id", buckets.alias("b")).collect()}
    raw = sum(grams.values(), Counter())
    for i in (0, 7, 39, 40, 79):
        seen = sum((grams[k] for k in range(40) if k != i), Counter())
        model = quality.log_ratios({b: (seen[b], raw[b]) for b in raw}, 256)
        assert abs(out[i]._score - sum(model[b] * n for b, n in grams[i].items()) / grams[i].total()) < 3


# 3


def test_sharding(docs, rows, empty):
    out = sharding.assign(docs, 16).collect()
    assert Counter((r._size, r._crc32) for r in out) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r._shard].append(r._slot)
        assert r._grown in (r._shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(empty).count() == 0


def test_weighted_shards(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    n = {r._shard: r["count"] for r in sharding.assign(df, [1.0, 2.0, 0.0, 1.0]).groupBy("_shard").count().collect()}
    assert 2 not in n and abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02
    moved = sharding.assign(df, 16).where("_shard <> _grown")
    assert moved.where("_grown <> 16").count() == 0 and abs(moved.count() / 20_000 - 1 / 17) < 0.01


# 4


def removed_by_hand(rows, n):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    count = Counter(tuple(w[i : i + n]) for w in docs for i in range(len(w) - n + 1))
    out = []
    for (d, _, _), w in zip(rows, docs, strict=True):
        away = {k for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        out.append((d, len(w), len(away), " ".join(x for i, x in enumerate(w) if i not in away)))
    return out


@pytest.mark.parametrize("window", [35, 9])
def test_substrings(docs, rows, empty, window):
    out = substrings.find_repeats(docs, window=window).collect()
    expected = removed_by_hand(rows, window)
    same([tuple(r) for r in out], expected)
    assert sum(e[2] > 0 for e in expected) > 10
    assert substrings.find_repeats(empty).count() == 0


def test_fingerprints_are_guaranteed():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50, 3000).astype(np.uint64)
    places, _ = substrings.selected(words, 35)
    for i in range(len(words) - 34):
        assert ((places >= i) & (places + substrings.GRAM <= i + 35)).any()
    base = 0x9E3779B97F4A7C15
    assert len(set(substrings._rolled(words, 35, base).tolist())) == len(words) - 34
    assert (substrings._rolled(words[100:200], 35, base) == substrings._rolled(words, 35, base)[100:166]).all()


def test_index_over_sessions(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    batches = [[1, 2, 3], [3, 4], [5, 5], [1, 6, 7], [7, 8], [2], [9]]
    for k, b in enumerate(batches):
        session = spark.newSession()  # the folder's manifest is all that one session leaves to the next
        index = substrings.FingerprintIndex(session, folder, fanout=3)
        hits = {r.fp for r in index.add(session.createDataFrame([(x, 100 * k + x) for x in b], "fp long, key long")).collect()}
        before = {x for old in batches[:k] for x in old}
        assert hits == {x for x in b if x in before or b.count(x) > 1}
        where = {(r.fp, r.key) for r in index.locations(session.createDataFrame([(1,), (7,)], "fp long")).collect()}
        assert where == {(x, 100 * i + x) for i, old in enumerate(batches[: k + 1]) for x in old if x in (1, 7)}
        assert len(index.runs) <= 3 and max([r["tier"] for r in index.runs]) == (k >= 2)
    index.compact()
    assert len(substrings.FingerprintIndex(spark, folder).runs) == 1 and len(list((tmp_path / "index").glob("run-*"))) == 1
    plan = index._open(index.runs[0]["name"]).join(index._open(index.runs[0]["name"]).hint("merge"), "fp", "left_semi")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_substrings_of_new_batches_against_history(spark, docs, rows, tmp_path):
    parts = [docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(3)) == k) for k in range(3)]
    folder, seen, expected = f"file://{tmp_path}/index", None, {}
    for part in parts:
        now = [tuple(r) for r in part.select("doc_id", "text", "fp").collect()]
        old = [] if seen is None else [tuple(r) for r in seen.select("doc_id", "text", "fp").collect()]
        index = substrings.FingerprintIndex(spark, folder, fanout=2)
        out = substrings.find_repeats(part, 35, batches=1, index=index, history=seen).collect()
        same([tuple(r) for r in out], removed_by_hand(now + old, 35)[: len(now)])
        seen = part if seen is None else seen.union(part)


# 5


def hits_by_hand(rows, items, n):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = tok(t)
        if i is not None and w:
            for k in range(max(1, len(w) - n + 1)):
                windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for d, t, _ in rows:
        w, hit, names = tok(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[k : k + size]))) and size:
                    hit |= set(range(k, k + size))
                    names |= found
        out.append((d, len(w), len(hit), tuple(sorted(names))))
    return out


def test_decontaminate(spark, docs, rows, empty):
    items = [(1, prose(random.Random(9), 40)), (2, " ".join(rows[5][1].split()[700:740])), (10, " ".join(rows[5][1].split()[730:760]).upper()), (3, "one"), (4, None), (None, "the of"), (5, ""), (2, "The END"), (6, "ünder1, THE2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for max_bytes in (16_000_000, 150):
        out = decontaminate.find_contaminated(docs, bench, max_bytes=max_bytes).collect()
        same([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out], hits_by_hand(rows, items, 10))
        kept = decontaminate.drop_contaminated(docs, bench, max_bytes=max_bytes)
        assert kept.columns == docs.columns and kept.count() == sum(not h for _, _, h, _ in hits_by_hand(rows, items, 10))
    assert decontaminate.find_contaminated(empty, bench).count() == 0
    assert decontaminate.find_contaminated(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_longest_matches(spark, docs, rows):
    tokens = {i: decontaminate.words_of(t) for i, t, _ in rows if i is not None and i != 3}
    words = tokens[5]
    repeat = b" ".join(words[40:52]).decode()
    items = [(1, "nothing " + b" ".join(words[100:123]).decode() + " else"), (2, "unseen"), (3, f"{repeat} {repeat}"), (4, b" ".join([*words[300:330], *words[310:340]]).decode())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = docs.where("doc_id IS NOT NULL AND doc_id <> 3").dropDuplicates(["doc_id"])
    best = {(r.item_id, r.start): (r.words, r.doc_id, r.place) for r in decontaminate.longest_matches(known, bench, min_match=2).collect()}
    at = defaultdict(list)
    for d, w in tokens.items():
        for k in range(len(w) - 1):
            at[w[k], w[k + 1]].append((d, k))
    expected = {}
    for i, text in items:
        w = decontaminate.words_of(text)
        for s in range(len(w) - 1):
            found = []
            for d, k in at[w[s], w[s + 1]]:
                n = 2
                while s + n < len(w) and k + n < len(tokens[d]) and w[s + n] == tokens[d][k + n]:
                    n += 1
                found.append((-n, d, k))
            if found:
                n, d, k = min(found)
                expected[str(i), s] = (-n, d, k)
    assert best == expected and best["1", 1] == (len(decontaminate.words_of(items[0][1])) - 2, 5, 100)
    out = {r.doc_id: r.longest for r in decontaminate.find_contaminated(known, bench, window=10).collect()}
    assert tuple(out[5]) == (30, "4", 0, 300) or tuple(out[5]) == (30, "4", 30, 310)
    assert all((r is None) == (d != 5 and not any(n >= 10 for n, x, _ in best.values() if x == d)) for d, r in out.items() if d == 5 or r is None)


# 7


def test_warc(spark, tmp_path):
    same_page = "<html>é</html>"
    data = [(i, f"http://{h}.example.com/p/{i % 7}?q#f", same_page if i % 3 == 0 else f"<p>{i}" * 50) for i, h in enumerate(["a", "WWW.b", "c"] * 300)]
    data += [(1000, None, None), (1003, "-", "dash"), (1001, "not a url", ""), (None, "http://x.org", same_page), (1002, 'http://e.org/"\\\n', "z")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write_archive(pages, folder)
    out = {r.page_id: r for r in warc.read_captures(pages, folder).collect()}
    groups = defaultdict(list)
    for i, _, h in data:
        groups[h or ""].append(-1 if i is None else i)
    assert len(out) == len(data)
    for i, url, h in data:
        r, best = out[i], max(groups[h or ""])
        payload = (h or "").encode()
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), url)
        response = best == (-1 if i is None else i)
        assert (r.record_type, r.refers_to) == (("response", None) if response else ("revisit", best))
        assert r.payload == (payload if response else None)
    one = warc.read_captures(pages.where("page_id = 4"), folder).collect()
    assert len(one) == 1 and warc.read_captures(spark.createDataFrame([(5, "http://no.where")], "page_id long, url string"), folder).count() == 0
    few = f"file://{tmp_path}/few"
    warc.write_archive(pages, few, min_payload=1000)
    assert warc.read_captures(pages, few).where("record_type = 'revisit'").count() == 0
    none = f"file://{tmp_path}/none"
    warc.write_archive(pages.limit(0), none)
    assert warc.read_captures(pages.limit(0), none).count() == 0


def test_warc_parts_and_repeated_rows(spark, tmp_path):
    data = [(i % 80, f"http://h{i % 7}.org/{i % 80}", f"page {i % 50}") for i in range(240)]
    pages, folder = spark.createDataFrame(data, "page_id long, url string, html string"), f"file://{tmp_path}/w"
    warc.write_archive(pages, folder, file_bytes=2000)
    assert warc.open_index(spark, folder).count() > 12
    out = warc.read_captures(pages, folder).collect()
    same([(r.page_id, r.url, r.payload_bytes) for r in out], [(i, u, len(h)) for i, u, h in data])


def test_capture_index_of_many_blocks():
    part, files = warc._Part(), {}
    lines = sorted((f"org,h{i % 40})/{i % 9}", i % 500) for i in range(4 * warc.BLOCK_LINES + 7))
    for k, (key, page) in enumerate(lines):
        part.add(key, page, 10, f"d{k}")

    class Out(bytearray):
        def write(self, data):
            self.extend(data)

    class Files:
        def read(self, name, at, n):
            return files[name][at : at + n]

        def size(self, name):
            return len(files[name])

    out = Out()
    part.write_blocks(out)
    files |= {"p.cdx": bytes(out), "p.dir": json.dumps(part.directory).encode()}
    index = warc.CaptureIndex(Files(), "p")
    assert len(index.directory) == 5
    for key, page in set(lines):
        assert [x[4] for x in index.find(key, page)] == [f"d{k}" for k, x in enumerate(lines) if x == (key, page)]
    assert index.find("org,h1)/0", 7000) == [] and index.find("", 0) == [] and index.find("z", 1) == []


def test_capture_keys():
    keys = {
        "https://WWW.Example.com:443/a?b#c": "com,example,www)/a?b",
        "http://u@h.org:8080": "org,h:8080)/",
        "x": "x",
        None: "-",
    }
    assert {u: warc.capture_key(u) for u in keys} == keys


# 8


def test_rans_blocks():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 60, 700)
    counts[9] = 10**7
    freq = rans.scale(counts)
    assert freq.sum() == 1 << rans.BITS and ((freq > 0) == (counts > 0)).all()
    table = rans.Table(freq)
    blocks = [rng.choice(np.flatnonzero(counts), n) for n in (1, 63, 64, 65, 1000, rans.BLOCK)]
    coded = rans.encode_blocks(blocks, table)
    assert all((a == b).all() for a, b in zip(blocks, rans.decode_blocks(coded, list(map(len, blocks)), table), strict=True))
    single = rans.Table(rans.scale(np.array([0, 7])))
    assert (rans.decode_blocks(rans.encode_blocks([np.ones(500, int)], single), [500], single)[0] == 1).all()


def test_rans_archive(spark, docs, rows, empty, tmp_path, monkeypatch):
    path, folder = tokenizer_path("byte_bpe_50k.json"), f"file://{tmp_path}/r"
    rans.write_archive(docs, folder, path, 2)
    out = sorted(rans.read_archive(spark, folder, keep_ids=True).collect(), key=lambda r: r.start)
    t = CachedEncoder(path, True).tokenizer
    expected = [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for i, x, _ in rows]
    same([(r.id, bytes(r.ids)) for r in out], expected)
    order = [(r.id is not None, r.id or 0) for r in out]
    assert order == sorted(order)
    at = 0
    for r in out:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    files = Ranges(folder)
    for f in spark.read.parquet(f"{folder}/manifest").where("n_ids > 100").collect():
        blocks = rans.read_index(files, f.file)[0]
        table = rans.Table(np.frombuffer((tmp_path / "r" / "table.bin").read_bytes(), dtype="<u4"))
        whole = rans.read_ids(files, f.file, blocks, 0, f.n_ids, table)
        assert (rans.read_ids(files, f.file, blocks, 40, 50, table) == whole[40:90]).all()
        file = tmp_path / "r" / f.file
        file.write_bytes(file.read_bytes()[:600] + b"\x00\x01" + file.read_bytes()[602:])
        with pytest.raises(ValueError):
            rans.read_ids(Ranges(folder), f.file, blocks, 0, f.n_ids, table)
    small = f"file://{tmp_path}/s"
    rans.write_archive(docs, small, path, 2, file_ids=50)  # many files a task; a document of 5,000 words in one of them
    assert spark.read.parquet(f"{small}/manifest").where("no > 0").count() > 3
    assert sorted(rans.read_archive(spark, small, keep_ids=True).collect(), key=lambda r: r.start) == out
    with pytest.raises(TypeError):
        rans.write_archive(docs.withColumn("doc_id", F.col("doc_id").cast("string")), small, path, 2)
    rans.write_archive(empty, f"file://{tmp_path}/e", path, 2)
    assert rans.read_archive(spark, f"file://{tmp_path}/e").count() == 0


def test_rans_many_blocks(monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 128)
    monkeypatch.setattr(rans, "GROUP", 2)

    class Out(bytearray):
        def write(self, data):
            self.extend(data)

    class Files:
        def __init__(self, data):
            self.data = bytes(data)

        def read(self, _, at, n):
            return self.data[at : at + n]

        def size(self, _):
            return len(self.data)

    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 90, n) for n in (1, 700, 3, 128, 5, 400, 1)]
    table = rans.Table(rans.scale(np.bincount(np.concatenate(docs), minlength=90)))
    out = Out()
    writer = rans._Writer(out, table)
    for i, d in enumerate(docs):
        writer.add(None if i == 0 else i, d.astype("<u2"))
    writer.close()
    n = len(writer.blocks)
    assert n == 10
    got = []
    for batch in rans._read_file(Files(out), "f", 5, table, True):
        got += batch.to_pylist()
    assert [r["id"] for r in got] == [None, 1, 2, 3, 4, 5, 6]
    assert all((np.frombuffer(r["ids"], "<u4") == d).all() for r, d in zip(got, docs, strict=True))
    assert got[1]["start"] == 6


# 9


def lines_by_hand(rows, w):
    """(row, kept text, lines, removed): windows in the order of id, row key and place."""
    seqs = []
    for d, text, _, key in rows:
        parts = [] if text is None else text.split("\n")
        seqs.append((d, key, text, parts, [i for i, x in enumerate(parts) if re.search(r"[^\x20\x09-\x0D]", x)]))
    first = {}
    where = lambda d, key, at: ((d is not None, d or 0), key, at)
    for d, key, _, parts, at in seqs:
        for k in range(len(at) - w + 1):
            content = tuple(parts[i] for i in at[k : k + w])
            first[content] = min(first.get(content, where(d, key, at[k : k + w])), where(d, key, at[k : k + w]))
    out = []
    for d, key, text, parts, at in seqs:
        gone = set()
        for k in range(len(at) - w + 1):
            if where(d, key, at[k : k + w]) > first[tuple(parts[i] for i in at[k : k + w])]:
                gone |= set(at[k : k + w])
        out.append((d, None if text is None else "\n".join(x for i, x in enumerate(parts) if i not in gone), len(at), len(gone)))
    return out


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_dedup(spark, docs, rows, empty, run):
    keyed = docs.select("doc_id", "text", "fp", F.xxhash64("doc_id", "text").alias("k")).collect()
    extra = spark.createDataFrame([(500, "a\nb\n\nc\nz"), (501, "q\na\nb\nc\nd"), (502, "b\nc\nd"), (503, "t\nt\nt\nt")], "doc_id long, text string").withColumn("fp", F.lit("n"))
    both = docs.unionByName(extra)
    keyed = [tuple(r) for r in both.select("doc_id", "text", "fp", F.xxhash64("doc_id", "text")).collect()]
    expected = lines_by_hand(keyed, run)
    marked = lines.mark_repeated_lines(both, run).collect()
    same([(r.doc_id, r._n_lines, r._n_removed) for r in marked], [(d, n, g) for d, _, n, g in expected])
    out = lines.drop_repeated_lines(both, run)
    assert out.columns == both.columns
    same([(r.doc_id, r.text) for r in out.collect()], [(d, t) for d, t, _, _ in expected])
    assert sum(g > 0 for _, _, _, g in expected) > 5
    assert lines.drop_repeated_lines(empty, run).count() == 0


def test_long_lines_repeat_alone(spark):
    import corpus_pipeline

    rng = random.Random(10)
    long, short = prose(rng, 20), prose(rng, 19)
    rows = [(1, f"a\n{long}\nb\n{short}"), (2, f"c\n{long}\n{short}\nd"), (3, long), (4, f"{short}\n{long} \ne"), (5, None), (6, f"{short}\n\nd\n{long}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert out == {1: rows[0][1], 2: f"c\n{short}\nd", 3: "", 4: rows[3][1], 5: None, 6: ""}
    marked = lines.mark_repeated_lines(docs, 2, alone=20).orderBy("doc_id").collect()
    assert [(r._n_lines, r._n_removed) for r in marked] == [(4, 0), (4, 1), (1, 1), (3, 0), (0, 0), (3, 3)]


def test_columns_of_any_name_stay(spark):
    names = ["_bucket", "_start", "_i", "_n", "_digest", "_h", "_b", "_t", "_total", "_key", "_key2", "_k", "_dropped", "key", "key2", "k", "dropped", "c0", "c1", "fp", "root"]
    text = "one two three\nfour five\nsix"
    rows = [(1, text, *range(len(names))), (2, f"{text}\nseven", *range(100, 100 + len(names))), (3, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    expected = {r[0]: r[2:] for r in rows}
    for out in (
        sharding.assign(docs, 4),
        lines.mark_repeated_lines(docs),
        lines.drop_repeated_lines(docs),
        quality.judge(docs, docs.where("doc_id = 1")),
        simhash.drop_near_duplicates(docs),
        jaccard.drop_near_duplicates(docs),
        decontaminate.drop_contaminated(docs, docs.selectExpr("9 AS item_id", "'x y' AS text")),
    ):
        got = {r.doc_id: tuple(r[n] for n in names) for r in out.collect()}
        assert got == {i: v for i, v in expected.items() if i in got} and len(got) >= 2


# 10


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\", "[\\[/ANS]</s>", "\\<[", "", None, "[ANS] x [/ANS]</s><s>", "a\nb", "日本<"]
    rows = [(c, k, r, t) for c, t in enumerate(nasty) for k, r in enumerate(["user", "assistant", "system", "tool]", None, "assistant"])]
    rows.append((0, 2, "user", "tie"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.replies_of_turns(df))
    back = {r.tree: r for r in out.select("tree", chat.parse(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m"), "formatted").collect()}
    for c in range(len(nasty)):
        mine = sorted(((k, r or "", t or "") for d, k, r, t in rows if d == c), key=lambda x: x)
        assert [(t.role, t.text) for t in back[c].t] == [(r, t) for _, r, t in mine]
        assert back[c].m == "".join(t for _, r, t in mine if r == "assistant")
    assert chat.format_trees(chat.replies_of_turns(df.limit(0))).count() == 0


def test_reply_trees(spark):
    #       1 -> 2 -> 4        scores make 1-3-5 best by sum, 1-3-6 next
    #         -> 3 -> 5, 6     7 has a parent that isn't there; 8 and 9 answer each other, and 10 answers 8
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 2.0), ("t", 4, 2, 1.0), ("t", 5, 3, 3.0), ("t", 6, 3, 2.0), ("u", 7, 99, 1.0), ("v", 8, 9, 1.0), ("v", 9, 8, 1.0), ("v", 10, 8, 5.0), ("t", 5, 3, 3.0)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, score double")
    out = defaultdict(list)
    for r in chat.branches(df, keep=2).collect():
        out[r.tree, r["rank"]].append((r.depth, r.id))
    assert {k: [i for _, i in sorted(v)] for k, v in out.items()} == {("t", 1): [1, 3, 5], ("t", 2): [1, 3, 6], ("u", 1): [7]}
    long = spark.range(1, 301).select(F.lit("x").alias("tree"), "id", F.nullif(F.col("id") - 1, F.lit(0)).alias("parent"), F.lit(1.0).alias("score"))
    path = [r.id for r in chat.branches(long).orderBy("depth").collect()]
    assert path == list(range(1, 301))


@pytest.mark.parametrize("rank_by", ["sum", "mean", "leaf"])
def test_reply_trees_by_hand(spark, rank_by):
    rng = random.Random(12)
    rows = []
    for tree in range(6):
        for i in range(1, 60):
            up = None if i == 1 or rng.random() < 0.03 else rng.randrange(max(1, i - 4), i) if rng.random() < 0.9 else rng.randrange(1, 60)
            rows.append((tree, i, up if up != i else None, rng.randrange(20) / 4))
    expected = {}
    for tree in range(6):
        up = {i: p for t, i, p, _ in rows if t == tree}
        score = {i: x for t, i, _, x in rows if t == tree}
        paths = []
        for leaf in set(up) - set(up.values()):
            path = [leaf]
            while up[path[-1]] is not None and len(path) < 99:
                path.append(up[path[-1]])
            total = sum(score[i] for i in path)
            if len(path) < 99:
                paths.append((-{"sum": total, "mean": total / len(path), "leaf": score[leaf]}[rank_by], leaf, path[::-1]))
        expected |= {(tree, k): p for k, (_, _, p) in enumerate(sorted(paths)[:3], 1)}
    got = defaultdict(list)
    for r in chat.branches(spark.createDataFrame(rows, "tree long, id long, parent long, score double"), 3, rank_by=rank_by).orderBy("depth").collect():
        got[r.tree, r["rank"]].append(r.id)
    assert got == expected


def test_reply_trees_write_chosen_paths_only(spark):
    rows = [("t", i, i - 1 or None, 0.0) for i in range(1, 61)] + [("t", 100 + i, i, 9.0 if i == 1 else 0.0) for i in range(1, 61)]
    scratch = Scratch(spark, "spine")
    out = chat.branches(spark.createDataFrame(rows, "tree string, id long, parent long, score double"), 1, scratch)
    assert [r.id for r in out.orderBy("depth").collect()] == [1, 101]
    written = sum(spark.read.parquet(str(p)).count() for p in Path(scratch.root.removeprefix("file://")).glob("*-path"))
    assert written <= 2 * 8  # a branch of two messages, in each round


def test_turns_of_a_conversation_without_id(spark):
    rows = [(None, 1, "user", "a"), (None, None, "user", "b"), (None, 5000, "assistant", "c"), (None, -7, "system", "d")]
    out = chat.replies_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("id").collect()
    assert [(r.tree, r.id, r.parent, r.text) for r in out] == [(None, 1, None, "b"), (None, 2, 1, "d"), (None, 3, 2, "a"), (None, 4, 3, "c")]
