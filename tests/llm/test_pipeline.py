"""Stages of the pipeline, each against brute force on its own input."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_near_dedup import brute as near_brute


def test_stages(spark, tmp_path):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(2000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(30))) for k in range(5)]
    docs, labels = [], []
    for k in range(300):
        words = text(r.randint(40, 120))
        junk = k % 4 == 0
        if junk:
            words = [w + r.choice(["###", "$$$", "&&&"]) for w in words]
        docs.append((k, " ".join(words)))
        labels.append((k, int(not junk), 0))
    good = [k for k in range(300) if k % 4]
    for k in range(300, 330):  # exact copies but for white space
        docs.append((k, docs[r.choice(good)][1].replace(" ", "  ", 1)))
    for k in range(330, 360):  # near copies
        words = docs[r.choice(good)][1].split()
        words[0] = "changed"
        docs.append((k, " ".join(words)))
    for k in range(360, 370):  # test items
        docs.append((k, " ".join(text(40)) + " " + items[k % 5][1] + " " + " ".join(text(40))))
    docs.append((370, None))
    folder = str(tmp_path)
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], names).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    now = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/out{k}")
        before, now = now, spark.read.parquet(f"{folder}/out{k}")
        if k < 4:
            assert now.columns == before.columns
        seen.append((before.select("doc_id", "text").collect() if k < 5 else None, now.collect()))
    clean = {k for k in good} | set(range(300, 370))
    kept = [{x.doc_id for x in after} for _, after in seen]
    assert len(clean - kept[0]) <= 3 and len({k for k in range(0, 300, 4)} & kept[0]) <= 4

    groups = defaultdict(list)
    for x in seen[1][0]:
        groups[re.sub(r"\s", "", x.text or "")].append((-len(x.text or ""), x.doc_id))
    assert kept[1] == {min(own)[1] for own in groups.values()}

    classes = near_brute([(x.doc_id, x.text) for x in seen[2][0]])
    assert kept[2] == {next(iter(s))[0] for s in classes.values()}

    held = lambda t: any(i in (t or "") for _, i in items)
    assert kept[3] == {x.doc_id for x in seen[3][0] if not held(x.text)}

    assert kept[4] == kept[3]
    room = defaultdict(int)
    for x in seen[4][1]:
        room[x.sequence_id] += x.length
    assert max(room.values()) <= 1024

    whole = corpus_pipeline.run(spark, folder).collect()
    assert {(x.doc_id, x.piece, x.length, x.ids_crc32) for x in whole} == {(x.doc_id, x.piece, x.length, x.ids_crc32) for x in seen[4][1]}
