import json
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
from quillrank.cli import main


def make(root):
    for split in ("train", "dev"):
        at = root / "tsv" / split
        at.mkdir(parents=True)
        news = [f"N{i}\tcat{i % 2}\tsub{i % 3}\tTitle number{i} topic{i % 2}\tAbstract\tu\t[{{\"WikidataId\":\"Q{i % 4}\"}}]\t[]" for i in range(8)]
        (at / "news.tsv").write_text("\n".join(news) + "\n")
        rows = [f"{k * 7 % 13}\tU{k % 3}\t11/{10 + k}/2019 9:00:00 AM\tN{k % 8} N{(k + 1) % 8}\tN{(k + 2) % 8}-1 N{(k + 3) % 8}-0 N{(k + 4) % 8}-0" for k in range(1, 13)]
        (at / "behaviors.tsv").write_text("\n".join(rows) + "\n")
    (root / "entity.vec").write_text("".join(f"Q{i}\t" + "\t".join(str(float((i + d) % 5)) for d in range(100)) + "\n" for i in range(4)))


def test_store_and_evaluation(spark, tmp_path):
    make(tmp_path)
    out = str(tmp_path / "store")
    counts = main(["data", "--source-root", str(tmp_path), "--output", out, "--validation-days", "3"], spark)
    assert counts["mind"]["articles"] == 8 and counts["mind"]["test"] == 4
    assert sum(counts["mind"].values()) - 8 == 24
    assert json.loads((tmp_path / "store/manifest.json").read_text()) == counts
    recall = main(["bm25", "--store", out, "--output", str(tmp_path / "r.json")], spark)
    assert {r["slice"] for r in recall} == {"all", "cold_history_under_5"} and all(0 <= r["value"] <= 1 for r in recall)
    vec = str(tmp_path / "entity.vec")
    assert all(r["value"] == 1.0 for r in main(["semantic", "--store", out, "--vectors", vec], spark) if r["metric"] == "recall_200")
    rows = main(["evaluate", "--store", out, "--vectors", vec], spark)
    assert {r["method"] for r in rows} == {"bm25", "semantic"}
    want = {"auc", "mrr", "ndcg_5", "ndcg_10", "diversity", "novelty"}
    for method in ("bm25", "semantic"):
        mine = [r for r in rows if r["method"] == method]
        assert {(r["slice"], r["metric"]) for r in mine} == {(s, m) for s in ("all", "cold_history_under_5") for m in want} | {("all", "coverage_10")}
        assert all(r["ci95_low"] <= r["mean"] <= r["ci95_high"] for r in mine if r["metric"] != "coverage_10")
        assert [r["observed_full_sample"] for r in mine if r["metric"] == "coverage_10"] == [0.625]  # articles 2 to 6 of 8


def lines_of(archive, name):
    with zipfile.ZipFile(archive) as z:
        return z.read(name).decode().splitlines()


def test_submissions_of_a_text_log_keep_its_order(spark, tmp_path):
    make(tmp_path)
    train, test = (str(tmp_path / f"tsv/{s}/behaviors.tsv") for s in ("train", "dev"))
    more = ["--articles", str(tmp_path / "tsv/train/news.tsv"), "--vectors", str(tmp_path / "entity.vec")]
    for method in ("popularity", "affinity", "hybrid"):
        assert main(["submit", "--train", train, "--test", test, "--output-dir", str(tmp_path / method), "--method", method, *more], spark)
        assert [x.split()[0] for x in lines_of(tmp_path / method / "prediction.zip", "prediction.txt")] == [str(k * 7 % 13) for k in range(1, 13)]
    got = main(["compare", "--train", train, "--labelled", test, "--methods", "log_popularity", "affinity", "category_popularity", "hybrid", *more], spark)
    assert [r["method"] for r in got] == ["log_popularity", "affinity", "category_popularity", "hybrid"]
    assert all(r["impressions"] == 12 and 0 <= r["auc"] <= 1 for r in got)


def test_submissions_of_a_parquet_log(spark, tmp_path):
    import datetime as dt

    now = dt.datetime(2024, 1, 10)
    pq.write_table(pa.table({"article_id": [1, 2, 3], "category_str": ["a", "b", None], "topics": [["x"], ["y"], None], "published_time": [now, now - dt.timedelta(hours=96), None]}), tmp_path / "articles.parquet")
    train = {"impression_id": [1, 2], "user_id": [7, 8], "impression_time": [now, now], "article_ids_inview": [[1, 2], [2, 3]], "article_ids_clicked": [[2], [2, 3]]}
    pq.write_table(pa.table(train), tmp_path / "train.parquet")
    pq.write_table(pa.table({"user_id": [7, 9], "article_id_fixed": [[1, 1], [3]]}), tmp_path / "history.parquet")
    test = {"impression_id": [30, 10, 20, 10], "user_id": [7, 9, 1, 7], "impression_time": [now] * 4, "article_ids_inview": [[2, 1, 3], [3, 2], [1, 2, 3], [1]], "article_ids_clicked": [[1], [3], [2], []]}
    pq.write_table(pa.table(test), tmp_path / "test.parquet")
    base = ["--format", "parquet", "--train", str(tmp_path / "train.parquet")]
    assert main(["submit", *base, "--test", str(tmp_path / "test.parquet"), "--output-dir", str(tmp_path / "pop")], spark)
    # clicks: 2 twice, 3 once
    assert lines_of(tmp_path / "pop/predictions.zip", "predictions.txt") == ["30 [1,3,2]", "10 [2,1]", "20 [3,1,2]", "10 [1]"]
    more = ["--articles", str(tmp_path / "articles.parquet"), "--history", str(tmp_path / "history.parquet")]
    assert main(["submit", *base, "--test", str(tmp_path / "test.parquet"), "--output-dir", str(tmp_path / "own"), "--method", "topic_fresh", *more], spark)
    # user 7 likes category a and topic x: article 1; user 9 the empty category: article 3; user 1 has no history: popularity and age
    assert lines_of(tmp_path / "own/predictions.zip", "predictions.txt") == ["30 [2,1,3]", "10 [1,2]", "20 [2,1,3]", "10 [1]"]
    got = main(["compare", *base, "--labelled", str(tmp_path / "test.parquet"), "--methods", "log_popularity", "history_category", "topic_fresh", *more], spark)
    by = {r["method"]: r for r in got}
    assert by["topic_fresh"]["impressions"] == 4 and by["topic_fresh"]["mrr"] == 0.75 and by["topic_fresh"]["auc"] == 0.75
    assert by["log_popularity"]["mrr"] == round((1 / 3 + 1 / 2 + 1) / 4, 6)
