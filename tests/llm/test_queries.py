"""The registered queries return the columns and types agreed for them, for every row of their table."""

import pytest

import __spark_entry__ as E
from vigil.llm.common import table

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2": "doc_id bigint, fingerprint string, component_id bigint",
    "op3": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5": "page_id bigint, url string, text string, n_chars bigint",
    "op6": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op9": "query_id bigint, rank int, vec_id bigint, score double",
    "op10": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op11": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op12": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    "op13": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
}


@pytest.mark.parametrize("op", sorted(COLUMNS))
def test_columns(spark, op):
    name, = [q for q in E.queries() if q.split("_")[0] == op]
    df = E.queries()[name](spark, SF)
    types = dict(df.dtypes)
    for column in COLUMNS[op].split(", "):
        key, kind = column.split(" ")
        assert types[key] == kind, (op, key, types[key])
    if op in ("op1", "op2", "op4", "op6", "op7", "op10", "op11", "op12", "op13"):
        ids = sorted(r.doc_id for r in df.select("doc_id").collect())
        assert ids == sorted(r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect())
    if op == "op5":
        assert df.count() == table(spark, SF, "pages").count()
