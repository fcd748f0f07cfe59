"""Operators against brute force on small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from llm_texts import prose
from pyspark.sql import functions as F

from chronoweave.llm import language_model as lm
from chronoweave.llm import pii
from chronoweave.llm.components import components
from chronoweave.llm.decontaminate import benchmark_passages, decontaminate
from chronoweave.llm.hamming import similar_pairs
from chronoweave.llm.html_text import extract_text, main_text
from chronoweave.llm.language import fit_languages, identify_languages
from chronoweave.llm.mixing import mix_sources, mixed_documents
from chronoweave.llm.near_dedup import drop_near_duplicates, simhash_components
from chronoweave.llm.quality_model import estimate_prior, fit_nnpu, fit_quality, keep_quality, score_quality
from chronoweave.llm.quality_rules import quality_rules
from chronoweave.llm.shared import persisted, persisted_map, shared_dir
from chronoweave.llm.warc import write_archive

words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_rules(odd):
    for r in quality_rules(odd).collect():
        for d in odd.where(F.col("doc_id").eqNullSafe(F.lit(r.doc_id))).collect():
            if len(words(d.text)) == r.n_words:
                ws = words(d.text)
                wins = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
                hit = {i + k for i in range(len(ws) - 4) if wins[tuple(ws[i : i + 5])] > 1 for k in range(5)}
                lines = [x for x in (d.text or "").split("\n") if words(x)]
                assert (r.word_chars, r.n_repeat_words, r.n_dup_lines) == (sum(map(len, ws)), len(hit), len(lines) - len(set(lines)))
                assert r.base_failed == (len(ws) < 10 or 100 * len(hit) > 20 * len(ws))
    assert quality_rules(odd).count() == odd.count()


def test_repeats(make):
    text = "a b c d e x a b c d e f a b c d e"
    junk = "w " * 300
    got = {r.doc_id: r for r in quality_rules(make([(1, text), (2, junk), (3, prose(200, 3))])).collect()}
    assert got[1].n_repeat_words == 15 and got[2].n_repeat_words == 300 and not got[2].kept and got[3].kept


def test_language_model(make, odd, monkeypatch):
    monkeypatch.setattr(lm, "DOCS_PER_SHARD", 8)
    docs = make([(i, prose(80, i % 30)) for i in range(60)]).union(odd)
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\n"]) for r in docs.collect()]
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    train = [w for i, w in rows if crc(i) % 10]
    c, b, t = Counter(), Counter(), Counter()
    for w in train:
        c.update(w)
        b.update(zip([b"\n", *w], w))
        t.update(zip([b"\n", *w], w, w[1:]))
    n, v = sum(c.values()), len(c)
    own = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    want = []
    for i, w in rows:
        base = sum(math.log10(own(x)) for x in w)
        after = [(b[(h, x)] + lm.STRENGTH * own(x)) / (c[h] + lm.STRENGTH) for h, x in zip([b"\n", *w], w)]
        pairs = list(zip([b"\n", *w], w))
        after[1:] = [(t[(*h, x)] + lm.PAIR_STRENGTH * p) / (b[h] + lm.PAIR_STRENGTH) for h, x, p in zip(pairs, w[1:], after[1:])]
        full = sum(map(math.log10, after))
        want.append((i is None, i or 0, len(w), sum(c[x] > 0 for x in w), round(base, 6), full))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6), r.score, r.train_tokens) for r in lm.score_corpus(docs).collect()]
    for w, g in zip(sorted(want), sorted(got)):
        assert w[:5] == g[:5] and g[6] == n and abs(w[5] - g[5]) < 0.01 * w[2] + 0.05


def test_elias_fano():
    from chronoweave.llm.elias_fano import EliasFano, pack, unpack

    rng = np.random.default_rng(0)
    for n, u in ((0, 10), (1, 1), (1000, 1000), (1000, 1 << 50), (70000, 1 << 60)):
        v = np.sort(rng.integers(0, u, n))
        ef = unpack(np.frombuffer(pack({}, {"e": EliasFano.build(v, u)}, {}), np.uint8))[1]["e"]
        q = np.r_[v, rng.integers(0, u, 500)]
        assert (ef.access(np.arange(n)) == v).all() and (ef.find(q) == np.searchsorted(v, q)).all()


def fingerprint(text):
    ws = (text or "").encode().lower().split()
    shingles = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [b" ".join(ws)] if ws else []
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def roots(items, links):
    par = {x: x for x in items}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in links:
        par[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in items}


def test_elias_fano_reads_whole_words(tmp_path):
    from chronoweave.llm.elias_fano import EliasFano, pack, unpack

    rng = np.random.default_rng(5)
    for bits in (0, 1, 7, 13, 31, 47, 62):
        values = np.sort(rng.integers(0, 1 << bits, 70))
        (tmp_path / "f").write_bytes(pack({"a": values}, {"s": EliasFano.build(values, 1 << bits)}, {}))
        arrays, sequences, _ = unpack(np.memmap(tmp_path / "f", np.uint8, mode="r"))
        got = sequences["s"]
        assert len(got.low) % 8 == 0  # two words hold any value, where eight single bytes were gathered
        assert type(arrays["a"]) is type(got.low) is type(got.high.ranks) is np.ndarray  # indexing a memmap runs Python code each time
        assert got.access(np.arange(70)).tolist() == values.tolist() and got.contains(values)[1].all()


def test_simhash(make, odd):
    docs = make([(100 + i, prose(50, i // 3) + (" end" if i % 3 else "")) for i in range(60)]).union(odd)
    got = simhash_components(docs).collect()
    fps = {r.doc_id: r.fp % (1 << 64) for r in got if r.doc_id is not None}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert all(fps[i] == fingerprint(t) for i, t in texts.items()) and len(got) == docs.count()
    ids = sorted(fps)
    near = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    root = roots(ids, near)
    assert all(r.component_id == root[r.doc_id] for r in got if r.doc_id is not None)


@pytest.mark.parametrize("radius", [1, 3, 7])
def test_hamming(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 62, 60)
    x = np.unique(np.r_[base, [int(b) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(1, 9), replace=False)) for b in np.repeat(base, 6)], -base])
    pairs = [(r.a, r.b) for r in similar_pairs(spark.createDataFrame([(int(v),) for v in x], "fp long"), radius).collect()]
    u = [int(v) % (1 << 64) for v in x]
    want = {(int(max(x[i], x[j])), int(min(x[i], x[j]))) for i in range(len(x)) for j in range(i) if (u[i] ^ u[j]).bit_count() <= radius}
    assert set(pairs) == want and len(pairs) == len(want)


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 430)] + [(500, k) for k in range(501, 560)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots({x for e in links for x in e}, links)
    assert got == {x: r for x, r in want.items() if any(x in e and e[0] != e[1] for e in links)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_few_edges_need_no_rounds(spark, monkeypatch):
    links = [(k, k + 1) for k in range(-60, 60)] + [(300, 200), (400, 300), (7, 7)]
    written = []

    def write(df, name):
        written.append(name)
        return df.localCheckpoint()

    edges = spark.createDataFrame(links, "u long, v long").repartition(5)
    got = {tuple(r) for r in components(edges, write).collect()}
    assert got == {(k, -60) for k in range(-60, 61)} | {(k, 200) for k in (200, 300, 400)}
    assert written == ["edges"]  # each write is a job, with files and folders of its own
    monkeypatch.setattr("chronoweave.llm.components.ONE_TASK_EDGES", 0)
    assert {tuple(r) for r in components(edges, write).collect()} == got and len(written) > 3


def test_near_dedup(make, odd):
    text = prose(300, 1)
    near = text.replace(" ", " zz ", 1)
    docs = make([(1, text), (2, text), (3, near), (9, prose(300, 2)), (9, prose(300, 2)), (None, text), (None, "alone and other words here"), (None, "alone and other words here"), (12, None), (13, "")])
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in drop_near_duplicates(docs).collect())
    assert got == [(False, 1), (False, 9), (False, 12), (True, 0)]
    assert drop_near_duplicates(odd).columns == odd.columns


def test_near_dedup_starts_no_processes_for_files(spark, make):
    """Hadoop's local file system starts some for each file, and leaves a .crc beside it."""
    root = Path(shared_dir(spark, "x").removeprefix("file:")).parent
    crc, tables = set(root.rglob("*.crc")), set(root.rglob("*.parquet"))
    docs = make([(i, prose(60 + i % 5, i // 2)) for i in range(40)])
    assert drop_near_duplicates(docs).count() < 40
    assert set(root.rglob("*.parquet")) > tables and set(root.rglob("*.crc")) == crc


@pytest.mark.parametrize("scheme", ["file", "viewfs"])
def test_tables_by_tasks(spark, tmp_path, monkeypatch, scheme):
    """Spark reads back what tasks have written, also in a store that only Spark knows and for no rows."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tasks.link./in", f"file://{tmp_path}")
    root = {"file": f"file://{tmp_path}/a b", "viewfs": "viewfs://tasks/in"}[scheme]
    monkeypatch.setattr("chronoweave.llm.shared.shared_dir", lambda s, name: f"{root}/{name}")
    df = spark.range(900, numPartitions=7).selectExpr("IF(id % 9 = 0, NULL, id) AS id", "array(id, -id) AS a", "struct(id % 2 = 0 AS x, cast(id AS int) AS y) AS s")
    assert sorted(map(str, persisted(df, "all", by_tasks=True).collect())) == sorted(map(str, df.collect()))
    assert persisted(df.limit(0), "none", by_tasks=True).collect() == []
    assert persisted_map(df.select("id"), lambda batches: batches, "id long", "map").agg(F.count("*"), F.sum("id")).first()[:] == df.agg(F.count("*"), F.sum("id")).first()[:]


def shingle_set(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_near_dedup_finds_all_links(make):
    """Against brute force on links at 0.8 to 0.95, in pairs and in one group of copies of a text."""
    texts = []
    for seed in range(30):
        ws = prose(150, 100 + seed).split()
        rng = np.random.default_rng(seed)
        texts.append(" ".join(ws))
        for _ in range(12 if seed == 0 else 1):
            other = list(ws)
            for k in rng.choice(len(ws), 1 + seed % 4, replace=False):
                other[k] = f"new{rng.integers(1 << 30)}"
            texts.append(" ".join(other))
    sets = [shingle_set(t) for t in texts]
    like = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])}
    links = [p for p, x in like.items() if x >= 0.8]
    assert sum(like[p] <= 0.95 for p in links) >= 20
    got = sorted(r.doc_id for r in drop_near_duplicates(make(list(enumerate(texts)))).collect())
    assert got == sorted(set(roots(range(len(texts)), links).values()))


def test_near_dedup_recall(make):
    """Of pairs that are just 0.8 to 0.85 alike nine in ten at least are found, and no pair below 0.8."""
    rows, links = [], []
    for seed in range(200):
        ws = prose(200, 5000 + seed).split()
        other, rng = list(ws), np.random.default_rng(seed)
        while len(shingle_set(" ".join(ws)) & shingle_set(" ".join(other))) > 0.835 * len(shingle_set(" ".join(ws)) | shingle_set(" ".join(other))):
            other[int(rng.integers(len(ws)))] = f"new{rng.integers(1 << 30)}"
        a, b = shingle_set(" ".join(ws)), shingle_set(" ".join(other))
        links.append(len(a & b) >= 0.8 * len(a | b))
        rows += [(2 * seed, " ".join(ws)), (2 * seed + 1, " ".join(other))]
    kept = {r.doc_id for r in drop_near_duplicates(make(rows)).collect()}
    joined = [2 * k + 1 not in kept for k in range(200)]
    assert sum(links) >= 60 and not any(j and not x for j, x in zip(joined, links)) and {2 * k for k in range(200)} <= kept
    assert sum(j and x for j, x in zip(joined, links)) >= 0.9 * sum(links)


def test_near_dedup_of_odd_ids(make):
    """An id with texts in two groups, groups of ids and of none, and an id that repeats where it is not the smallest."""
    a, b, c, d = (prose(80, 7000 + k) for k in range(4))
    rows = [(5, a), (5, b), (2, b), (9, c), (9, c), (None, c), (None, d), (None, d + " end"), (7, d.upper())]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in drop_near_duplicates(make(rows)).collect())
    assert got == sorted([(False, 5, a), (False, 2, b), (False, 9, c), (False, 7, d.upper())])


def test_near_dedup_compares_texts_of_one_fingerprint(make):
    """A line that repeats sets the SimHash, whatever else the texts say."""
    rows = [(i, f"{line} " * (300 // len(line.split())) + prose(20, i)) for i, line in enumerate(["menu"] * 3 + ["sign up here"] * 3)]
    rows.append((6, rows[0][1] + " " + rows[0][1]))
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)]
    got = sorted(r.doc_id for r in drop_near_duplicates(make(rows)).collect())
    assert got == sorted(set(roots(range(len(rows)), links).values())) and set(range(6)) <= set(got)


def test_languages(make):
    de, en = "der hund läuft schnell über die straße und bellt", "the dog runs fast over the street and barks"
    rows = [(i, " ".join(np.random.default_rng(i).permutation((de if i % 2 else en).split() * 5)), "de" if i % 2 else "en", "s", 0) for i in range(60)]
    docs = make(rows + [(90, None, "en", "s", 0), (91, "123 !!", None, "s", 0), (92, "straßen", None, None, 0), (None, "the", None, None, 0)])
    got = {r.doc_id: r for r in identify_languages(docs, fit_languages(docs)).collect()}
    assert all(got[r[0]].lang_pred == r[2] and 0 <= got[r[0]].score <= 1 for r in rows)
    assert got[90].lang_pred == got[91].lang_pred == "und" and got[92].lang_pred == "de" and got[None].lang_pred == "en"


def test_archive(spark):
    rows = [(1, "u\nx", None), (2, None, ""), (3, "a", "é" * 50000), (None, "b", "same"), (4, "b", "same"), (4, "b", "same"), (5, "c", "same"), (None, "q", "only"), (None, "q", "only"), (6, "d", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = write_archive(pages, shared_dir(spark, "warc"))
    got = sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload)) for r in archive.records().collect())
    top = {}
    for i, _, h in rows:
        top[h or ""] = max((x for x in (top.get(h or ""), i) if x is not None), default=None)
    want = []
    for i, _, h in rows:
        raw, main = (h or "").encode(), top[h or ""]
        want.append(str((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == main else "revisit", None if i == main else main, (h or "") if i == main else None)))
    assert got == sorted(want)
    one = archive.index.select("record_id").limit(1)
    assert archive.lookup(one).select("record_id").first() == one.first()
    assert write_archive(pages.limit(0), shared_dir(spark, "warc")).records().count() == 0


def test_decontamination(spark, make):
    item = prose(40, 77)
    edited = item.split()
    edited[20] = "changed"
    hidden = f"{prose(100, 1)} {item.upper()} {prose(100, 2)}"
    docs = make([(1, hidden), (2, f"{prose(50, 3)} {' '.join(edited)}"), (3, prose(200, 4)), (4, " ".join(item.split()[:12])), (5, "tiny item"), (None, item), (6, None), (7, "")])
    bench = spark.createDataFrame([(1, item), (2, "Tiny ITEM"), (3, None), (4, ""), (5, prose(30, 9))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 6), r.start) for r in benchmark_passages(docs, bench).collect()}
    expect = (36 - 5) / (36 + 5)
    assert got[(1, 1)] == (1.0, 100) and got[(None, 1)][0] == 1.0 and got[(5, 2)] == (1.0, 0)
    assert ((2, 1) in got) == (expect >= 0.8) and not [k for k in got if k[0] in (3, 4, 6, 7)]
    assert sorted(r.doc_id for r in decontaminate(docs, bench).collect()) == [i for i in (2, 3, 4, 6, 7) if (i, 1) not in got]
    assert benchmark_passages(docs, bench.limit(0)).count() == 0 and benchmark_passages(docs.limit(0), bench).count() == 0


def test_mix(make, odd):
    docs = make([(i, prose(10 + i % 50, i), "en", f"s{i % 7}" if i % 9 else None, 0) for i in range(400)]).union(odd)
    rows = mix_sources(docs).collect()
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sum(x.size for x in rows if x.source == r.source)
    assert abs(sum(own[0].target for own in by.values()) - total) < 1e-6
    level = {s: own[0].target / (5, 2, 1)[k % 3] for k, (s, own) in enumerate(sorted(by.items(), key=lambda e: (e[0] is None, e[0])))}
    free = [level[s] for s, own in by.items() if own[0].target < 3 * own[0].source_size - 1e-9]
    assert max(free) - min(free) < 1e-6 and all(level[s] <= max(free) + 1e-6 for s in by)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
        assert sum(r.taken % r.size not in (0,) for r in own if r.size) <= 1
    taken = Counter()
    for r in mixed_documents(docs).collect():
        taken[r.source] += r.taken
    assert all(abs(taken[s] - own[0].target) <= 0.5 for s, own in by.items())


def test_mix_of_repeated_ids(make):
    """Both forms give the same words of every source where a doc_id, null or not, has very many rows."""
    rows = [(7, "w " * (3 + i % 5), None, "a", 0) for i in range(30)] + [(None, "x y z", None, "a", 0)] * 9 + [(i, "q " * (i % 40), None, "b", 0) for i in range(100, 400)]
    rows += [(5, None, None, None, 0), (6, "a b", None, None, 0)] + [(8, "r s t u", None, "c", 0)] * 50
    for weights in ((5, 2, 1), (1, 7, 3), (2, 1, 9)):
        plan, mix, target = Counter(), Counter(), {}
        for r in mix_sources(make(rows), weights).collect():
            plan[r.source] += r.taken
            target[r.source] = r.target
        for r in mixed_documents(make(rows), weights).collect():
            mix[r.source] += r.taken
        assert plan == mix and all(abs(mix[s] - t) <= 0.5 for s, t in target.items())


def brute_windows(text, item, least=0.8):
    """Similarities at least ``least`` of all windows, by start."""
    w, x = (text or "").lower().split(), (item or "").lower().split()
    if not x or not w:
        return {}
    k, n = min(len(x), 5), len(x)
    bag = lambda y: Counter(tuple(y[i : i + k]) for i in range(len(y) - k + 1))
    own, out = bag(x), {}
    for s in range(max(1, len(w) - n + 1)):
        b = bag(w[s : s + n])
        common = sum((b & own).values())
        if b and common / (sum(b.values()) + sum(own.values()) - common) >= least:
            out[s] = common / (sum(b.values()) + sum(own.values()) - common)
    return out


def test_windows_against_all_windows(spark, make):
    """Every window of an item's size, with edits, repeats and texts that are shorter than the item."""
    rng = np.random.default_rng(5)
    items = [(i, prose(int(rng.integers(5, 60)), 300 + i)) for i in range(25)] + [(40, "la la la la la la la la la"), (41, "one two three")]
    rows = []
    for i, item in items:
        for v in range(4):
            ws = item.split()
            for at in rng.integers(0, len(ws), v):
                ws[at] = f"e{rng.integers(99)}"
            rows.append((len(rows), f"{prose(30, len(rows))} {' '.join(ws)} {prose(20, len(rows))}"))
        rows.append((len(rows), " ".join(item.split()[: -1 - i % 4])))
        rows.append((len(rows), f"{item} {prose(3, i)} {item} {item}"))
    rows += [(900, "la " * 30), (901, rows[0][1]), (901, rows[1][1])]
    want = {}
    for d, t in rows:
        for i, item in items:
            for start, x in brute_windows(t, item).items():
                want.setdefault((d, i), set()).add((start, round(x, 9)))
    found = benchmark_passages(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start, r.n_windows) for r in found}
    best = {k: (max(x for _, x in v), min(s for s, x in v if x == max(y for _, y in v)), len(v)) for k, v in want.items()}
    assert {k: x[:2] for k, x in got.items()} == {k: x[:2] for k, x in best.items()}
    assert all(x[2] <= best[k][2] for k, x in got.items()) and sum(x[2] for x in got.values()) >= 0.999 * sum(x[2] for x in best.values())  # windows that are just alike can lie beyond the radius


def test_quality_model(make, spark):
    rows = [(i, prose(120, i) if i % 4 else "bad### $$$ " * (20 + i % 30)) for i in range(300)]
    docs = make(rows + [(900, None), (901, "")])
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 300, 2)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    got = {r.doc_id: r._quality_score for r in score_quality(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 4 > 0) for i in held]) > 0.95 and all(0 <= v <= 1 for v in got.values())
    assert keep_quality(docs, labels).columns == docs.columns
    assert {r._quality_score for r in score_quality(docs, fit_quality(docs, labels.limit(0))).collect()} == {0.5}
    rng = np.random.default_rng(0)
    p, u = rng.normal(2, 1, (800, 3)), np.r_[rng.normal(2, 1, (600, 3)), rng.normal(-2, 1, (400, 3))]
    model = fit_nnpu(p, u, None)
    assert abs(model.prior - 0.6) < 0.15 and (model.score(u) > 0.5).mean() == pytest.approx(0.6, abs=0.1)
    assert 0.02 <= estimate_prior(np.ones(30), np.zeros(30)) <= 0.98


def test_html(spark):
    assert main_text(None) == "" and main_text("a &amp; b <b>c</b>d") == "a & b cd"
    page = '<body><div id="cookie-notice">x</div><header>h</header><div><h1>A</h1><p>one<br>two <b>thr</b>ee&nbsp;x<form>f</form><ul><li>a<li>b</ul><script>if (a<b) "</p>"</script><div class="comments">c</div></div><aside>s</aside><p>tail &lt;x&gt;'
    assert main_text(page) == "A one two three x a b tail <x>"
    assert main_text("<div>out</div><article><p>in</p></article>") == "in"
    rows = [(i, f"http://h/{i}", f"<body><div>Join our list</div><div><p>text {i}</p></div></body>") for i in range(30)] + [(99, None, None), (100, "nohost", "<p>y</p>")]
    got = {r.page_id: (r.text, r.n_chars) for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == ("text 7", 6) and got[99] == ("", 0) and got[100] == ("y", 1)
    quoted = [(i, f"http://h/{i}", f"<article><p>a passage that all quote</p><p>{i}</p></article>") for i in range(30)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(quoted, "page_id long, url string, html string")).collect()}
    assert got[3] == "a passage that all quote 3"


def test_html_parts():
    """What is beside the article goes by whole names, and never with an article in it."""
    assert main_text("<main><h1>T</h1><p>S.</p><article><p>B.</p></article></main><p>x</p>") == "T S. B."
    assert main_text(f"<article>Short teaser</article><div>{'long story ' * 9}</div>").startswith("Short teaser long story")
    for name in ("post tag-legal", "content no-sidebar", "site has-sidebar", "layout-sidebar-right", "category-social-media"):
        assert main_text(f'<div class="{name}"><p>kept</p></div>') == "kept"
    for name in ("sidebar", "cookie-notice", "comments", "comment-list", "site-footer x", "related-posts", "share-buttons"):
        assert main_text(f'<div class="{name}"><p>gone</p></div><p>kept</p>') == "kept"
        assert main_text(f'<div class="{name}"><h1>t</h1><p>kept</p></div>') == "t kept"


def test_html_is_linear():
    import time

    for broken in ("<a b ", "<a '>'", '<p class="x" ', "<div>", "<!-", "</", "<script", '<a ">', "<table><tr><td>"):
        began = time.time()
        main_text(broken * 40_000)
        assert time.time() - began < 10, broken


def test_site_templates(spark):
    """Counts of subtrees against brute force, on a small and a large host: the threshold does not grow with the host."""
    from chronoweave.llm.html_text import MIN_PAGES, parse, site_templates, subtrees

    rng = np.random.default_rng(2)
    rows = [(i, f"http://{'big' if i % 4 else 'small'}.example/{i}", f"<body><div>part {rng.integers(12)}</div><div>rare {rng.integers(60)}</div><p>own {i // 2 * 2}</p></body>") for i in range(300)]
    rows += [(999, "http://big.example/x", None), (998, None, rows[0][2]), (997, "", "")]
    held = {}
    for _, url, html in rows:
        if url:
            for own in subtrees(parse(html or "")):
                held.setdefault((url.split("/")[2], own), set()).add(html)
    want = {k for k, v in held.items() if len(v) >= MIN_PAGES}
    got = {(r.host, t) for r in site_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect() for t in r.templates}
    assert got == want and len(want) > 10


def base_of(t):
    t, sp = t or "", []
    sp += [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    sp += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0:
            sp.append((m.start(), 2, "card", m.end()))
    sp += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(sp))


def test_pii(spark, odd):
    import random

    rng = random.Random(1)
    bits = list("ab1 2.3-4@+()5 6789.. x_@@\n0") + ["4111 1111 1111 1111", "a.b@c.de.f", "1.2.3.4", "+1 (202) 555-0199", "é", "", ""]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(1500)] + [(5000, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (5001, "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), (5002, "call tel 202-555-0199 now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))
    got = pii.pii_digest(docs).collect()
    want = Counter((r.doc_id, hashlib.sha256(base_of(r.text).encode()).hexdigest()) for r in docs.collect())
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    by = {r.doc_id: r.spans for r in got}
    assert by[5000] == "secret:9:49" and by[5001] == "" and by[5002] == "tel:9:21"
    clean = {r.doc_id: r.text for r in pii.redact_pii(docs).collect()}
    assert clean[5000] == 'token = "[SECRET]"' and clean[6] == "mail me [EMAIL] or [PHONE]" and clean[7] == " [EMAIL] [IP]"


def test_language_scores(make):
    """Predictions against the definition: words of the sample first, then the longest n-grams of which any is known."""
    from chronoweave.llm import language as lg

    rows = [(i, prose(30, i) if i % 2 else prose(30, i)[::-1], "xx" if i % 2 else "yy", "s", 0) for i in range(40)] + [(80, "neverseen kitto", None, None, 0), (81, "Ω", None, None, 0)]
    train = [(t.lower(), lang) for i, t, lang, *_ in rows if lang and zlib.crc32(str(i).encode()) % 5]
    counts = Counter((w, lang) for t, lang in train for w in re.findall(r"[^\W\d_]+", t))
    grams = Counter()
    for (w, lang), n in counts.items():
        for k in range(1, lg.LONGEST + 1):
            for i in range(len(w) + 3 - k):
                grams[(f" {w} "[i : i + k], lang)] += n
    langs = ["xx", "yy"]

    def table(kept):
        names = {x for x, _ in kept}
        raw = {x: np.array([kept.get((x, g), 0.5) for g in langs]) for x in names}
        total = sum(raw.values()) if raw else 1
        return {x: np.log(v / np.maximum(total, 1)) for x, v in raw.items()}

    known = table({k: n for k, n in counts.items() if n >= lg.MIN_WORD})
    by_length = {k: table({g: n for g, n in grams.items() if len(g[0]) == k and n >= lg.MIN_GRAM}) for k in range(1, lg.LONGEST + 1)}

    def word(w):
        if w in known:
            return known[w]
        for k in range(min(lg.LONGEST, len(w) + 2), 0, -1):
            own = [by_length[k][g] for i in range(len(w) + 3 - k) if (g := f" {w} "[i : i + k]) in by_length[k]]
            if own:
                return np.mean(own, axis=0)
        return np.zeros(2)

    docs = make(rows)
    for r in identify_languages(docs, fit_languages(docs)).collect():
        ws = re.findall(r"[^\W\d_]+", next(t for i, t, *_ in rows if i == r.doc_id).lower())
        mean = sum(map(word, ws)) / len(ws) * min(len(ws), lg.SURE)
        share = np.exp(mean - mean.max())
        assert r.lang_pred == langs[int(mean.argmax())] and abs(r.score - share.max() / share.sum()) < 1e-9


EMPTY = {
    "rules": lambda s, d: quality_rules(d), "lm": lambda s, d: lm.score_corpus(d), "simhash": lambda s, d: simhash_components(d), "lang": lambda s, d: identify_languages(d, fit_languages(d)), "mix": lambda s, d: mix_sources(d),
    "mixed": lambda s, d: mixed_documents(d), "pii": lambda s, d: pii.pii_digest(d), "redact": lambda s, d: pii.redact_pii(d), "dedup": lambda s, d: drop_near_duplicates(d),
    "quality": lambda s, d: keep_quality(d, s.createDataFrame([], "doc_id long, quality int")),
    "bench": lambda s, d: decontaminate(d, s.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_odd_and_clashing(spark, odd, name):
    assert EMPTY[name](spark, odd.limit(0)).count() == 0
    clash = odd
    for c in ("words", "size", "fp", "spans", "n", "target", "lang_pred", "score", "h", "_text", "_words", "first_id", "base_spans", "places", "kept"):
        clash = clash.withColumn(c, F.lit("clash"))
    wide, plain = EMPTY[name](spark, clash), EMPTY[name](spark, odd)
    same = [c for c in plain.columns if c not in clash.columns or c in odd.columns]
    told = lambda df: Counter(str([r[c] for c in same]) for r in df.collect())
    assert told(wide) == told(plain) and wide.count() > 0


@pytest.mark.parametrize("name", ["archive", "html"])
def test_odd_pages(spark, name):
    rows = [(None, None, None), (1, "", ""), (2, "http://h/a", "<p>" + "x" * 300_000), (3, "http://h/b", "<a b " * 20_000), (4, "http://h/c", "é <p>y"), (4, "http://h/c", "é <p>y"), (5, "odd url", "<<>><p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    run = {"archive": lambda p: write_archive(p, shared_dir(spark, "warc")).records(), "html": extract_text}[name]
    clash = pages
    for c in ("sha", "main", "host", "page", "templates", "text", "payload", "known", "size"):
        clash = clash.withColumn(c, F.lit("clash"))
    told = lambda df: Counter(map(str, df.collect()))
    assert told(run(clash)) == told(run(pages)) and run(pages).count() == len(rows) and run(pages.limit(0)).count() == 0


def test_clashing_labels_and_items(make, spark):
    """Other columns of labels and benchmark change nothing; labels that contradict each other count as none."""
    docs = make([(i, prose(60, i) if i % 3 else "### $$$ bad " * 20) for i in range(90)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    twice = labels.union(spark.createDataFrame([(1000, 0), (1000, 1), (None, 1), (4, None)], labels.schema)).withColumns({c: F.lit("x") for c in ("text", "unlabelled", "x", "_most")})
    score = lambda l: {r.doc_id: round(r._quality_score, 9) for r in score_quality(docs, fit_quality(docs, l)).collect()}
    assert score(labels) == score(twice)
    item = spark.createDataFrame([(1, docs.where("doc_id = 4").first().text)], "item_id long, text string")
    wide = item.withColumns({c: F.lit("x") for c in ("doc_id", "n", "hs", "fp", "k", "ws", "start", "of")})
    assert benchmark_passages(docs, item).collect() == benchmark_passages(docs, wide).collect() != []


def test_fingerprints_of_a_batch_that_ends_with_a_full_block():
    """A batch whose last text fills a block leaves no text over, which is no error."""
    import pyarrow as pa

    from chronoweave.llm.fingerprint import BLOCK, fingerprint_batches

    long = " ".join(f"w{i}" for i in range(BLOCK + 2))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d", long])], ["doc_id", "text"])
    (found,) = fingerprint_batches([batch], 3, 42)
    assert found.column(0).to_pylist() == [1, 2] and [x % (1 << 64) for x in found.column(1).to_pylist()] == [fingerprint(t) for t in ("a b c d", long)]


def test_sets_of_a_batch_that_ends_with_a_full_block():
    """As for fingerprints, where near-dedup hashes the sets of shingles."""
    import pyarrow as pa

    from chronoweave.llm.fingerprint import BLOCK
    from chronoweave.llm.near_dedup import WORDS, _class_batches

    long = " ".join(f"w{i}" for i in range(BLOCK + 4))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c d e f", long])], ["doc_id", "text"])
    (found,) = _class_batches(5, [batch])
    assert found.column("size").to_pylist() == [2, BLOCK] and found.num_columns == 3 + WORDS
