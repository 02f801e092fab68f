"""The pipeline against brute force, stage by stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sigspark.llm import bpe, mixing, secret_scan, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, lang_pred string, component string"


def make(spark):
    def text(i):
        return " ".join(f"{w}{(i * 7 + k) % 50} the" for k, w in enumerate(["alpha", "beta", "gamma", "delta", "omega"] * 6))

    rows = [(i, text(i), "en", f"s{i % 4}", None, 1, "x", "y") for i in range(60)]
    rows += [(100, text(3), "en", "s1", 5, 1, "x", "y"), (101, None, "en", "s1", 5, 1, "x", "y"), (102, "123 !!", "en", None, 5, 1, "x", "y"), (3, text(3), "en", "s1", 5, 1, "x", "y"), (None, text(5), None, None, None, 1, "x", "y")]
    rows += [(103, text(70) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "en", "s2", 900, 1, "x", "y")]
    other = " ".join(f"word{k * 37 % 101} of" for k in range(40))
    rows += [(104, other + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "en", "s2", 900, 1, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_groups(texts):
    """The smallest place that links at a Jaccard similarity of 0.8 of five-word shingles reach, by all pairs."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    group, changed = list(range(len(texts))), True
    while changed:
        changed = False
        for i, j in near:
            low = min(group[i], group[j])
            changed |= group[i] != low or group[j] != low
            group[i] = group[j] = low
    return group


def test_stages(spark, tmp_path):
    docs = make(spark)
    path = str(tmp_path / "d.parquet")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        after = [r.asDict() for r in docs.collect()]
        if name == "language_id":
            assert sorted(str(r) for r in after) == sorted(str(r) for r in before if r["text"] and any(c.isalpha() for c in r["text"]))
        elif name == "simhash_dedup":
            group = plain_groups([r["text"] for r in before])
            least = {}
            for r, g in zip(before, group):
                key = (r["doc_id"] is None, r["doc_id"])
                least[g] = min(least.get(g, key), key)
            assert sorted((r["doc_id"] is None, r["doc_id"]) for r in after) == sorted(least.values())
        elif name == "secrets":
            assert len(after) == len(before)
            by = {r["doc_id"]: r for r in after}
            assert "04dbebab" not in by[104]["text"] and by[104]["n_chars"] == len(by[104]["text"])
            assert all(by[r["doc_id"]] == r for r in before if r["doc_id"] != 104)
        else:
            copies = {r["row"]: r for r in []}
            counts = {}
            for r in after:
                counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
            assert not copies and set(counts) <= {r["doc_id"] for r in before} and max(counts.values()) <= 2
            words = {r["doc_id"]: len(r["text"].split()) for r in before}
            total = sum(words[d] * n for d, n in counts.items())
            assert total == pytest.approx(1.5 * sum(words.values()), rel=0.1)
    last = cp.STAGES[-1][1](spark, docs, "")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = last.collect()
    assert len(rows) == docs.count()
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)


def test_run_and_empty(spark, tmp_path):
    make(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() > 0
    make(spark).where(F.lit(False)).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0


def test_each_stage_calls_its_operator():
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_dedup", "secrets", "source_mixing", "bpe"]
    assert cp.ORACLE_SQL is None and all(map(callable, (bpe.encode_decode, mixing.entropy_balance, secret_scan.scan)))


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline"} < names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_near_dedup_finds_edited_copies(spark):
    import random

    from sigspark.llm import near_copies

    rng = random.Random(5)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 80, 300]))]
        texts.append(" ".join(words))
        for edits in (0, 1, 2, 4):
            other = list(words)
            for _ in range(edits):
                at = rng.randrange(len(other))
                other[at : at + 1] = [f"v{rng.randrange(5000)}"] * rng.randrange(3)
            texts.append(" ".join(other))
    rng.shuffle(texts)
    group = plain_groups(texts)
    far = sum(bin((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[g])) & (2**64 - 1)).count("1") > 3 for i, g in enumerate(group))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 1, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = sorted(r["doc_id"] for r in cp.simhash_dedup(spark, docs, "").collect())
    assert far > 0 and got == sorted(set(group))


def test_near_dedup_of_a_large_set_over_blocks(spark, monkeypatch):
    import random

    from sigspark.llm import near_copies

    monkeypatch.setattr(near_copies, "BLOCK", 8)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(60):  # near copies of one text, then a chain that drifts away from it
        other = list(base)
        other[rng.randrange(120)] = f"v{k}"
        texts.append(" ".join(other))
    drift = list(base)
    for k in range(30):
        drift[4 * k] = f"d{k}"
        texts.append(" ".join(drift))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 1, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = sorted(r["doc_id"] for r in cp.simhash_dedup(spark, docs, "").collect())
    assert got == sorted(set(plain_groups(texts)))


def test_stages_do_not_depend_on_splits(spark, tmp_path):
    """Rows keep their numbers where splits change between two readings, as a lost executor changes them."""
    import random

    rng = random.Random(9)
    rows = [(i % 200, " ".join(f"w{rng.randrange(40)}" for _ in range(60)) if i < 200 else None, "en", f"s{i % 3}", None, 1, "x", "y") for i in range(200)]
    rows += [(1000 + i, rows[i][1], "en", "s0", None, 1, "x", "y") for i in range(60)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(path)
    old = cp.cut

    def moving(df, label="cut"):
        made = old(df, label)
        size = "4096" if spark.conf.get("spark.sql.files.maxPartitionBytes") != "4096" else "134217728"
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        return made

    for stage in (cp.simhash_dedup, cp.source_mixing):
        plain = sorted(map(str, stage(spark, spark.read.parquet(path), "").collect()))
        try:
            cp.cut = moving
            moved = sorted(map(str, stage(spark, spark.read.parquet(path), "").collect()))
        finally:
            cp.cut = old
            spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
        if stage is cp.simhash_dedup:
            assert moved == plain
        else:
            assert len(moved) == len(plain)
