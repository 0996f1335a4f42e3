import pyarrow as pa

from quillgrid.sources import batches, documents, pdf, tables


def test_a_batch_is_parsed_a_few_rows_at_a_time():
    seen = []

    def rows(n):
        seen.append(n)
        yield n, str(n)

    fields = pa.schema([("n", pa.int64()), ("s", pa.string())])
    out = batches.made(iter([pa.RecordBatch.from_pydict({"n": list(range(10_000))})]), rows, fields)
    first = next(out)
    assert len(seen) <= batches.ROWS_IN
    assert [r for b in (first, *out) for r in b["n"].to_pylist()] == list(range(10_000))


def test_a_large_file_is_handed_on_in_parts():
    fields = pa.schema([("n", pa.int64())])
    out = batches.made(iter([pa.RecordBatch.from_pydict({"n": [5_000]})]), lambda n: ((i,) for i in range(n)), fields)
    assert [b.num_rows for b in out] == [batches.ROWS_OUT] * 5


def test_readers_work_in_such_parts(spark):
    """Their plans hold one Arrow function and no pandas one, which would turn a whole batch into objects."""
    found = spark.createDataFrame([("a", b"x")], "path string, content binary")
    forms = spark.createDataFrame([("a", "<x/>")], "doc_id string, xml string")
    for made in (pdf.widgets(found), pdf.page_sizes(found), tables.sheet_rows(found), tables.csv_rows(found), documents.form_fields(forms)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "MapInPandas" not in plan
