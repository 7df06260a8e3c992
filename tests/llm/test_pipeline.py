"""The pipeline's stages over planted documents."""

from __future__ import annotations

import random
from collections import defaultdict


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(11)
    words = ["".join(rnd.choice("aeioustnrl") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, say(30)) for i in range(10)]
    shared = say(60)
    docs = {i: say(100) for i in range(300)}
    for i in range(0, 300, 6):
        docs[i] += " idiot scum moron"
    docs |= {400: docs[1], 401: docs[1], 402: docs[2] + "."}
    docs[7] = f"{say(20)} {shared} {say(20)}"
    docs[8] = f"{say(25)} {shared} {say(15)}"
    docs[9] = f"{say(20)} {items[3][1]} {say(30)}"
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if i < 4:
            assert out.columns == at.columns and out.schema == at.schema
        out.write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append({r.doc_id: r for r in at.collect()})
    assert set(kept[0]) == {i for i in docs if i >= 300 or i % 6}
    assert set(kept[1]) >= set(kept[0]) - {400, 401, 402} and not {400, 401} & set(kept[1])
    assert shared[20:-20] in kept[2][7].text and shared[20:-20] not in kept[2][8].text and kept[2][8].n_chars == len(kept[2][8].text)
    assert set(kept[2]) == set(kept[1]) and set(kept[3]) == set(kept[2]) - {9}
    parts = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        parts[r.doc_id] += r.length
    assert set(parts) == set(kept[3])


def test_odd_rows(spark, tmp_path):
    """Null texts and ids, empty and repeated rows, columns with clashing names, and empty tables go through all stages."""
    import corpus_pipeline

    rnd = random.Random(12)
    say = lambda n: " ".join(f"{rnd.randrange(10**6):x}" for _ in range(n))
    rows = [(i, say(60)) for i in range(40)] + [(None, say(50)), (None, None), (50, None), (51, ""), (3, "another text of its own " + say(30)), (60, say(20000))]
    rows += [rows[5], rows[5]]
    more = ["n_chars", "v", "lo", "n", "r", "key", "toxic", "score", "fp", "__id", "__v", "__lo", "__n", "length", "offset"]
    docs = spark.createDataFrame([(i, t, *[str(k) for k in range(len(more))]) for i, t in rows], "doc_id long, text string, n_chars string, " + ", ".join(f"{c} string" for c in more[1:]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(12)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, say(30)), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        assert i == 4 or out.schema == at.schema
        out.write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(at.count())
    # The repeated row and one of the three texts without words go; every other row stays.
    assert counts[0] == len(rows) and counts[1] == counts[2] == counts[3] == len(rows) - 3
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
