"""Rows and proximity matches of decontamination beyond the contracted digest."""

from tallyloom.llm import decontam


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_passes_keep_a_row_for_each_row(spark):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(11))) for i in range(6)]
    held = [t for _, t in items]
    clean = " ".join(f"c{j}" for j in range(11))
    rows = [(1, held[0]), (1, held[0]), (1, held[1]), (None, held[2]), (None, clean), (None, clean), (2, clean), (3, f"{held[4]} {held[5]}"), (None, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {}
    for chunk in (1 << 20, 40):
        got = decontam.decontaminate(table(spark, rows), bench, chunk_bytes=chunk).collect()
        found[chunk] = sorted((str(r.doc_id), r.n_words, list(zip(r.starts, r.ends)), r["items"]) for r in got)
    assert len(found[40]) == len(rows) and found[40] == found[1 << 20]
    assert ("None", 11, [], []) in found[40] and ("1", 11, [(0, 11)], [1]) in found[40]


def test_near_query_finds_changed_windows_and_counts_repeats(spark, tmp_path):
    item = "red green red blue tall old small cold warm dry wet new long short late"
    put = item.replace("cold", "cold x").replace("red blue", "blue red")
    fewer = "red green blue tall old small cold warm dry x y"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table(spark, [(1, f"a b {put} c"), (2, fewer), (3, item), (4, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    near = {r.doc_id: r for r in decontam.op4_decontamination_near(spark, str(tmp_path)).collect()}
    assert [near[i].near_items for i in (1, 2, 3, 4)] == [[1], [], [1], []]
    exact = {r.doc_id: r for r in decontam.op4_decontamination(spark, str(tmp_path)).collect()}
    assert all(near[i].n_hit == exact[i].n_hit and near[i].items_sha256 == exact[i].items_sha256 for i in exact)
    assert exact[1].n_items == 0 and exact[3].contaminated
