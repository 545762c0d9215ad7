"""The pipeline's stages: what each keeps, told by brute force, and one after the other."""

import corpus_pipeline


def lower(text):
    return (text or "").encode().lower()


def shingles(text):
    words = lower(text).split()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def last_of_equal(texts, _):
    stays = {}
    for i, text in sorted(texts.items()):
        stays[lower(text)] = i
    return set(stays.values())


def first_of_near(texts, _):
    sets, group = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and 100 * common >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return {i for i in group if group[i] == i}


def without_items(texts, items):
    wanted = [own for own in map(shingles, items) if own]
    sets = {i: shingles(t) for i, t in texts.items()}
    return {i for i in texts if not any(100 * len(own & sets[i]) >= 75 * len(own) for own in wanted)}


BRUTE = {"exact dedup": last_of_equal, "near dedup": first_of_near, "decontamination": without_items}


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == columns, name
        own = {r["doc_id"] for r in kept.select("doc_id").collect()}
        texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        assert own <= set(texts) and 0.5 * n < len(own)
        assert name == "quality" or own == BRUTE[name](texts, items), name
        docs = docs.where(docs["doc_id"].isin([*own]))
    rows = corpus_pipeline.run(spark, folder).select("doc_id", "sequence_id", "offset", "length").collect()
    assert {r["doc_id"] for r in rows} == own
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024
