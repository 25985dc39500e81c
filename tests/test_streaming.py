from clausewright.streaming import drop_folder


def test_each_content_is_analysed_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, body in (("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two"), ("d.txt", "")):
        (folder / name).write_text(body)
    seen: dict[str, int] = {}

    def run():
        files = drop_folder.first_of_content(drop_folder.dropped(spark, str(folder)))
        known = lambda: spark.createDataFrame([(h,) for h in seen], "content_hash string")

        def analyse(batch, batch_id):
            for row in batch.collect():
                seen[row.content_hash] = seen.get(row.content_hash, 0) + 1

        drop_folder.analyse_each(files, known, analyse, str(tmp_path / "state")).awaitTermination(120)

    run()
    assert len(seen) == 2
    (folder / "e.txt").write_text("two")
    (folder / "f.txt").write_text("three")
    run()
    assert sorted(seen.values()) == [1, 1, 1]
