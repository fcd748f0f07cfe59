"""The stages of corpus_pipeline against plain versions of them."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import numpy as np
from llm_texts import prose
from pyspark.sql import functions as F
from test_operators import base_of, brute_windows, roots, shingle_set

from chronoweave.llm.quality_model import fit_quality, score_quality

JUNK = "### $$$ bad | line "


def _tables(spark, folder):
    """Documents with copies, near copies, benchmark passages, personal data, nulls and repeats, of three sources."""
    rng = np.random.default_rng(4)
    items = [(i, prose(40, 900 + i)) for i in range(4)]
    texts = [prose(60 + i % 70, i) for i in range(150)] + [JUNK * (10 + i % 9) for i in range(40)]
    for i in range(25):
        ws = texts[i].split()
        ws[int(rng.integers(len(ws)))] = "edited"
        texts += [texts[i], " ".join(ws)]
    texts += [f"{prose(50, 500 + i)} {items[i % 4][1]} {prose(20, 600 + i)}" for i in range(12)]
    texts += [f"{prose(50, 700 + i)} write to a.b{i}@c.de or 10.0.0.{i} {prose(9, 800 + i)}" for i in range(12)] + [None, ""]
    rows = [(i, t, "en", (None, "a", "b", "c")[i % 4], 0) for i, t in enumerate(texts)]
    rows += [rows[3], (rows[5][0], prose(70, 999), "en", "a", 0), (None, prose(70, 998), "en", "b", 0), (None, prose(70, 998), "en", "b", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not (t or "").startswith("###")), 0) for i, t, *_ in rows[:190:2]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def _redacted(text):
    """The base spans of a text replaced by their kinds; those that overlap by the first one's."""
    spans, out, at = [x.split(":") for x in base_of(text).split(",") if x], "", 0
    for kind, a, b in spans:
        if int(a) >= at:
            out += text[at : int(a)] + f"[{kind.upper()}]"
        at = max(at, int(b))
    return out + text[at:]


def test_run(spark, tmp_path):
    rows, items = _tables(spark, str(tmp_path))
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    scores = {(r.doc_id, r.text): r._quality_score for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    kept = [r for r in rows if scores[r[:2]] >= 0.3]
    assert np.mean([(r in kept) == (not r[1].startswith("###")) for r in rows if r[1]]) > 0.9

    sets = [shingle_set(r[1]) for r in kept]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or (a | b and len(a & b) >= 0.8 * len(a | b))]
    groups = {}
    for i, r in roots(range(len(kept)), links).items():
        groups.setdefault(r, []).append(kept[i])
    order = lambda r: (r[0] is None, r[0] or 0)
    kept = [min(g, key=order) for g in groups.values()]

    bad = {r[0] for r in kept for _, item in items if brute_windows(r[1], item)}
    kept = [r for r in kept if r[0] not in bad]
    assert len(bad) >= 12
    kept = [(*r[:1], _redacted(r[1]) if r[1] else r[1], *r[2:]) for r in kept]

    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    total = Counter()
    for r in kept:
        total[r[3]] += size(r)
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, budget = {}, set(names), float(sum(total.values()))
    while True:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            break
        target |= {s: 3.0 * total[s] for s in over}
        free -= over
        budget -= sum(target[s] for s in over)
    target |= {s: level * weight[s] for s in free}
    want = Counter()
    for s in names:
        own = sorted((r for r in kept if r[3] == s), key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), order(r), size(r)))
        epochs, rest = divmod(round(target[s]), total[s])
        for r in own:
            n = min(size(r), rest)
            rest -= n
            if epochs * size(r) + n:
                want[(r[0], r[1], s, size(r), epochs * size(r) + n)] += 1
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.text, r.source, r["size"], r.taken) for r in got.collect()) == want


def test_stages_keep_columns(spark, tmp_path):
    _tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.count() == 0 and (out.columns == docs.columns or k == len(corpus_pipeline.STAGES) - 1)
        wide = docs.withColumns({c: F.lit("clash") for c in ("key", "root", "_row", "ws", "of", "spans", "_size", "_key", "_cut", "_before", "x")})
        assert stage(spark, wide, str(tmp_path)).count() == stage(spark, docs, str(tmp_path)).count()
