import json
import time


import pytest
from pyspark.sql import functions as F

from peerlens.operators import calls, enrichment, judging, retrieval, seeds
from peerlens.plans import fixtures, similar
from peerlens.sources import paged, readers, sinks, vector_sink
from tests import transports


@pytest.fixture
def notes(tmp_path):
    (tmp_path / "notes").mkdir()
    return str(tmp_path / "notes")


@pytest.fixture
def directory_file(tmp_path):
    rows = [{"name": f"Company {i}", "slug": f"c{i}", "batch": "Winter 2020" if i % 3 else "Winter 1999", "team_size": i, "tags": ["a", "b"][: i % 3], "former_names": []} for i in range(57)]
    path = tmp_path / "directory.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def same_rows(a, b):
    key = lambda df: sorted(json.dumps(r.asDict(), default=str) for r in df.collect())
    return key(a) == key(b)


@pytest.mark.parametrize("known", [True, False])
def test_pages_equal_the_file(spark, directory_file, notes, known):
    """A transport that fails twice for each page still gives all rows; the number of pages may be unknown."""
    made = paged.read_directory_pages(spark, transport="tests.transports:file_pages", file=directory_file, notes=notes, page_size=10, fails=2, backoff=0.01, partitions=3, known=str(known).lower())
    want = readers.read_directory(spark, directory_file, multi_line=False)
    assert same_rows(made, want) and made.count() == 38
    assert set(transports.asked(notes)) >= {f"page-{i}" for i in range(6)}


def test_pages_that_fail_for_good_fail_the_read(spark, directory_file, notes):
    made = paged.read_pages(spark, transport="tests.transports:file_pages", file=directory_file, notes=notes, page_size=10, fails=99, attempts=2, backoff=0)
    with pytest.raises(Exception, match="page 0 failed 2 times: ConnectionError"):
        made.count()


def test_tasks_share_the_rate(spark, directory_file, notes):
    began = time.monotonic()
    paged.read_pages(spark, transport="tests.transports:file_pages", file=directory_file, notes=notes, page_size=10, per_second=5, partitions=2).count()
    assert time.monotonic() - began > 0.7  # three pages in each of two tasks, 0.4 s apart


def test_policy_backs_off_and_gives_up(monkeypatch):
    slept = []
    monkeypatch.setattr(calls.time, "sleep", slept.append)
    policy, tries = calls.Policy(attempts=4, backoff=1.0), []

    def call(x):
        tries.append(x)
        if len(tries) < 4:
            raise OSError("no")
        return "yes"

    assert policy.tried(call, 1) == ("yes", None, 4) and slept == [1.0, 2.0, 4.0]
    assert calls.Policy(attempts=2, backoff=0).tried(lambda x: 1 / 0, 1) == (None, "ZeroDivisionError: division by zero", 2)


def test_one_bad_seed_of_a_hundred(spark, notes, tmp_path):
    """99 answers and one error row; the further pass asks the failed seed only."""

    def answer(prompt):
        if prompt == "p 17":
            raise RuntimeError("provider down")
        return prompt.upper()

    asked = spark.range(100).select(F.col("id").alias("seed_id"), F.concat(F.lit("p "), F.col("id").cast("string")).alias("prompt"))
    live = judging.Live(transports.counting(notes, answer), f"file://{tmp_path}/work", calls.Policy(attempts=2, backoff=0.01))
    rows = live.ask(asked).collect()
    assert len(rows) == 100 and sum(r["error"] is None for r in rows) == 99
    bad = next(r for r in rows if r["error"])
    assert bad["seed_id"] == 17 and bad["error"] == "RuntimeError: provider down" and bad["response"] is None and bad["attempts"] == 4 and bad["seconds"] >= 0.02
    seen = transports.prompts(notes)
    assert len(seen) == 103 and seen.count("p 17") == 4


def _judge(prompt):
    if "lost" in prompt.split("\n")[0].lower():
        raise TimeoutError("judge")
    if "garbled" in prompt.split("\n")[0].lower():
        return "not json"
    return json.dumps({"ranked_candidates": [{"candidate_id": "C01", "tier": "tier_1", "tier_rationale": "near", "criterion_matches": [{"criterion_id": 1, "match": True, "evidence": "e"}]}]})


def _criteria(prompt):
    if "Silent" in prompt:
        return '{"criteria": []}'
    return json.dumps({"criteria": [{"id": 1, "text": "makes things", "rationale": "r"}, {"text": "sells things"}, {"id": 3, "text": " "}]})


def test_failing_models_become_rows(spark, sf_dir, tmp_path):
    """A judge that raises, one that answers nonsense and criteria that are missing: error rows with seconds, all other seeds go on."""
    names = {"r:50": "Lost", "r:100": "Garbled", "r:150": "Good", "r:190": "Silent"}
    c = fixtures.corpus(spark, sf_dir)
    renamed = F.coalesce(*[F.when(F.col("record_id") == i, F.lit(n)) for i, n in names.items()], F.col("name"))
    c, v = c.withColumn("name", renamed), fixtures.vectors(spark, sf_dir)
    asked = seeds.requests(spark, [{"seed_id": n, "query": i} for i, n in names.items()] + [{"seed_id": "none", "query": "r:99999"}])
    twins = spark.createDataFrame([], "directory_id string, registry_id string")
    policy, work = calls.Policy(attempts=1, backoff=0), f"file://{tmp_path}/work"
    options = similar.Options(k=5, broad_tags=fixtures.BROAD, work=work, criteria_model=judging.Live(_criteria, work, policy), judge_model=judging.Live(_judge, work, policy))
    result = similar.similar_to(asked, c, twins, v, options)
    rows = {r["seed_id"]: r for r in similar.run_summary(result).collect()}
    assert rows["Lost"]["error"] == "judge: TimeoutError: judge" and rows["Garbled"]["error"] == "judge: unreadable answer"
    assert rows["Silent"]["error"] == "criteria: unreadable answer" and rows["none"]["error"] == "not_found"
    assert rows["Good"]["error"] is None and rows["Good"]["n_total"] == 1 and rows["Good"]["n_tier_1"] == 1
    assert all(rows[n]["seconds"] >= 0 for n in names.values()) and rows["none"]["seconds"] is None
    matched = {r["criterion_id"]: r["match"] for r in result.verdicts.where("seed_id = 'Good'").collect()}
    assert matched == {1: True, 2: False}
    assert {r["seed_id"] for r in result.documents.where("candidate_count_total > 0").collect()} == {"Good", "Silent"}


def test_prompts_say_what_is_known(spark):
    s = spark.createDataFrame([("s", "Acme", "x" * 3000, ["a", "b"], "peers in Europe", None), ("t", "Other", None, None, "", "Big Co")], "seed_id string, name string, description string, industries array<string>, user_query string, competitors_summary string")
    one, two = (r["prompt"] for r in judging.criteria_prompts(s).orderBy("seed_id").collect())
    assert "Wanted: peers in Europe\nCompany: Acme\nIndustries: a, b\nDescription: " + "x" * 2500 + "\nLeave" in one and "Competitors" not in one
    assert "Wanted: companies similar to Other\nCompany: Other\nDescription: none\nCompetitors: Big Co\n" in two
    shown = spark.createDataFrame([("s", "r2", 2, "Second", 0.25, None), ("s", "r1", 1, "First", 0.5, "d" * 700)], "seed_id string, record_id string, rank int, name string, cosine double, description string")
    asked = spark.createDataFrame([("s", 2, "sells"), ("s", 1, "makes")], "seed_id string, criterion_id int, text string")
    made = judging.prompts(s, judging.labelled(shown), criteria=asked).first()["prompt"]
    assert made == "Company: Acme\nCriteria:\n1. makes\n2. sells\nCandidates:\n[C01] First (similarity 0.500): " + "d" * 600 + "\n[C02] Second (similarity 0.250): "


def test_verify_candidates_asks_the_judge(spark):
    shown = spark.createDataFrame([("s", "r1", "makes bread", ["food"])], "seed_id string, record_id string, description string, industries array<string>")
    criteria = spark.createDataFrame([("s", 1, "Bread"), ("s", 2, "steel")], "seed_id string, criterion_id int, text string")
    got = {r["criterion_id"]: (r["match"], r["tier"]) for r in judging.verify_candidates(shown, criteria).collect()}
    assert got == {1: (True, "tier_2"), 2: (False, "tier_2")}
    assert judging.verify_candidates(shown, criteria, lambda a, b: b.limit(0)).count() == 0


def test_live_enrichment_asks_once(spark, notes, tmp_path):
    def answer(domain):
        if domain == "down.com":
            raise OSError("down")
        return {"empty.com": "[]", "none.com": '{"results": [], "name": null}', "bad.com": "{", "list.com": '[{"name": "x"}]', "found.com": '{"results": [{"name": "x"}]}'}.get(domain)

    domains = spark.createDataFrame([(d,) for d in ("down.com", "empty.com", "none.com", "bad.com", "list.com", "found.com", "void.com")], "domain string")
    exact = enrichment.live(transports.counting(notes, answer), f"file://{tmp_path}/work", calls.Policy(attempts=1))
    fuzzy = enrichment.live(lambda d: '{"name": "guess"}' if d == "empty.com" else None, f"file://{tmp_path}/work")
    got = {r["domain"]: r["raw"] for r in enrichment.with_retry(exact, fuzzy)(domains).collect()}
    assert {d for d, raw in got.items() if raw} == {"list.com", "found.com", "empty.com"} and len(got) == 7
    assert sorted(transports.prompts(notes)) == sorted(got)


def test_committed_vectors_survive_a_failing_run(spark, notes, tmp_path):
    """A run that dies keeps its finished files whole; the next one embeds the rest only."""
    import pyarrow as pa

    path = f"{tmp_path}/vectors"
    rows = spark.range(200, numPartitions=1).select(F.col("id").cast("string").alias("record_id"))

    def embedder(fails):
        def run(batches):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for i in range(0, len(ids), 10):
                    part = ids[i : i + 10]
                    if fails and "130" in part:
                        time.sleep(1)
                        raise RuntimeError("embedder down")
                    with open(f"{notes}/asked-{fails}", "a") as f:
                        f.write("\n".join(part) + "\n")
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([[float(x)] * 2000 for x in part], pa.list_(pa.float32()))], names=["record_id", "embedding"])

        return lambda df: df.select("record_id").mapInArrow(run, "record_id string, embedding array<float>")

    with pytest.raises(Exception, match="embedder down"):
        vector_sink.append(embedder(True)(rows), path, every=2, batch_rows=20)
    kept = vector_sink.read_cache(spark, path)
    n = kept.count()
    assert 0 < n <= 130 and n % 40 == 0
    assert not (tmp_path / "vectors" / "_pending").exists() or not list((tmp_path / "vectors" / "_pending").iterdir())
    vector_sink.append(embedder(False)(retrieval.missing(rows, kept)), path, every=2, batch_rows=20)
    again = (tmp_path / "notes" / "asked-False").read_text().split()
    assert len(again) == 200 - n
    got = {r["record_id"]: list(r["embedding"]) for r in vector_sink.read_cache(spark, path).collect()}
    assert got == {str(i): [float(i)] * 2000 for i in range(200)}
    with pytest.raises(Exception, match="appended to only"):
        rows.withColumn("embedding", F.array(F.lit(1.0).cast("float"))).write.format("vector_cache").mode("overwrite").option("path", path).save()


def test_results_are_found_again(spark, tmp_path):
    made = spark.createDataFrame([("a", 1, ["x"]), ("b", None, None)], "slug string, n int, tags array<string>")
    sinks.write_results(made, str(tmp_path / "out"))
    (tmp_path / "out" / "late_results.json").write_text('{\n  "n": 7\n}')
    (tmp_path / "out" / "broken_results.json").write_text("{")
    got = {r["slug"]: (r["n"], r["tags"]) for r in readers.read_results(spark, str(tmp_path / "out"), "n int, tags array<string>").collect()}
    assert got == {"a": (1, ["x"]), "b": (None, None), "late": (7, None)}
    (tmp_path / "empty").mkdir()
    assert readers.read_results(spark, str(tmp_path / "empty")).count() == 0


def test_part_pages_read_row_groups(tmp_path, monkeypatch):
    """Pages across row groups, each group read once by the pages that follow each other, not the table by every page."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from peerlens.plans import extended

    path = str(tmp_path / "part.parquet")
    pq.write_table(pa.table({"p_partkey": list(range(95)), "p_name": [f"n{i}" for i in range(95)], "p_size": list(range(95)), "other": ["x"] * 95}), path, row_group_size=13)
    read, whole = [], pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, i, **k: read.append(i) or whole(self, i, **k))
    monkeypatch.setattr(pq, "read_table", lambda *a, **k: pytest.fail("the whole table"))
    pages = [extended._part_pages(i, {"path": path, "page_size": "10"}) for i in range(11)]
    assert [r["slug"] for p in pages for r in p["records"]] == [f"s{i}" for i in range(95)] and {p["pages"] for p in pages} == {10}
    assert pages[-1]["records"] == [] and read == list(range(8))
