"""The faults of failed answers against those that the schema library reports."""
import json
import random
import re

import pytest

from invoxa.functions.jsonish import parse_header, parse_lines
from invoxa.operators.responses import OVERLOAD_MARKERS, classify_attempts, resolve_attempts
from tests.conftest import one
from pyspark.sql import functions as F

X = F.col("x")


def models():
    pydantic = pytest.importorskip("pydantic")
    opt = (str | None, None)
    header = pydantic.create_model("Header", **{f: opt for f in ("supplierName", "invoiceNumber", "invoiceDate", "kvkNumber", "vatNumber")})
    case = pydantic.create_model("Case", validatedClientCaseNumber=(str, ...), rawClientCaseNumber=opt, date=opt,
                                 durationHours=(float | None, None))
    return (pydantic.create_model("HeaderResult", invoiceHeader=(header, ...), isCoachingInvoice=(bool, ...)),
            pydantic.create_model("LinesResult", clientCases=(list[case], []), clientCasesNoActivity=(list[str], [])))


def random_value(r):
    return r.choice(["x", "503", "it's", "Unavailable", 'say "429"', "a\\b\n", 503, 429, 1, 0, 2, 1.5, 503.25, 12345678.0, True, False, None,
                     [], [503], {"a": 429}, {"k": [True, None, "overloaded"]}, "long " * 9 + "503", "503" + " long" * 12, "2.5", "yes"])


def answers(n):
    r = random.Random(21)
    for _ in range(n):
        header = {f: random_value(r) for f in ("supplierName", "invoiceNumber", "kvkNumber", "other") if r.random() < 0.4}
        root = {"invoiceHeader": r.choice([header, header, header, random_value(r)]), "isCoachingInvoice": r.choice([True, True, random_value(r)])}
        root = {k: v for k, v in root.items() if r.random() < 0.95}
        yield "header", json.dumps(r.choice([root] * 9 + [random_value(r)]))
        items = []
        for _ in range(r.randint(0, 3)):
            item = {"validatedClientCaseNumber": r.choice(["A", "A", random_value(r)]), "rawClientCaseNumber": r.choice(["a", random_value(r)]),
                    "durationHours": r.choice([1, 2.0, random_value(r)]), "note": random_value(r)}
            items.append(r.choice([{k: v for k, v in item.items() if r.random() < 0.8}] * 6 + [random_value(r)]))
        root = {"clientCases": r.choice([items, items, items, random_value(r)]), "clientCasesNoActivity": [random_value(r) for _ in range(r.randint(0, 2))]}
        yield "lines", json.dumps({k: v for k, v in root.items() if r.random() < 0.8})


def test_faults_and_classes(spark):
    header, lines = models()
    rows, want = [], {}
    for i, (agent, text) in enumerate(answers(400)):
        if not text.startswith("{"):
            text = '{"invoiceHeader": ' + text + "}"
        rows.append((i, agent, 0, text, None))
        try:
            (header if agent == "header" else lines).model_validate_json(text)
            want[i] = "ok"
        except ValueError as e:
            want[i] = "retry" if any(m in str(e).lower() for m in OVERLOAD_MARKERS) else "stop"
    df = spark.createDataFrame(rows, "doc_id long, agent string, attempt int, response_text string, error string")
    got = {x["doc_id"]: x["cls"] for x in classify_attempts(df).collect()}
    assert {i: (got[i], rows[i][3]) for i in got if got[i] != want[i]} == {}
    assert min(sum(v == k for v in want.values()) for k in ("ok", "retry", "stop")) > 30


@pytest.mark.parametrize("agent", ["header", "lines"])
def test_shown_values(spark, agent):
    from invoxa.functions.jsonish import carve_json, item_facts, parse_response
    from invoxa.functions.validation import header_faults, lines_faults, message_words
    model = models()[agent == "lines"]
    texts = [t for a, t in answers(300) if a == agent and t.startswith("{")]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    df = df.withColumn("c", carve_json(X)).withColumn("j", parse_response(X, agent == "lines")).withColumn("f", item_facts(F.col("j")))
    faults = header_faults(F.col("j"), F.col("c")) if agent == "header" else lines_faults(F.col("j"), F.col("c"), F.col("f"))
    for row in df.select("x", message_words(faults).alias("w")).collect():
        try:
            model.model_validate_json(row["x"])
            assert row["w"] == ["0"]
        except ValueError as e:
            want = [str(len(e.errors()))]
            shown = re.findall(r"input_value=(.*), input_type=", str(e))
            for err, value in zip(e.errors(), shown):
                want += [".".join(map(str, err["loc"])), value]
            assert sorted(row["w"]) == sorted(want), row["x"]


def test_last_of_duplicate_keys(spark):
    twice = '{"invoiceHeader": {"kvkNumber": 5}, "isCoachingInvoice": "maybe", "invoiceHeader": {"kvkNumber": "1", "kvkNumber": "2", "z": {"a": 1, "a": 2}}, "isCoachingInvoice": true}'
    got = one(spark, parse_header(X), "Sure:\n" + twice + "\nDone.")
    assert got.isCoachingInvoice is True and got.invoiceHeader.kvkNumber == "2"
    assert one(spark, parse_header(X), '{"invoiceHeader": {"kvkNumber": "1", "kvkNumber": 2}, "isCoachingInvoice": true}') is None
    assert one(spark, parse_header(X), twice + " {}") is None and one(spark, parse_header(X), twice + ", " + twice) is None
    assert one(spark, parse_header(X), "{'invoiceHeader': {}, 'isCoachingInvoice': true}") is None
    case = '{"validatedClientCaseNumber": "A", "durationHours": 1, "durationHours": "2.5"}'
    got = one(spark, parse_lines(X), f'{{"clientCases": [], "clientCases": [{case}], "x": 1, "x": 2}}')
    assert [c.durationHours for c in got.clientCases] == [2.5] and got.clientCasesNoActivity == []
    assert one(spark, parse_lines(X), f'{{"clientCases": [{case}], "clientCasesNoActivity": null}}') is None
    assert one(spark, parse_lines(X), f'{{"clientCases": [{case}, {{}}]}}') is None


def test_retry_after_a_failed_line_item(spark):
    bad = '{"clientCases": [{"validatedClientCaseNumber": "A", "durationHours": "503 h"}]}'
    good = '{"clientCases": [{"validatedClientCaseNumber": "A", "durationHours": 2}]}'
    rows = [(1, "lines", 0, bad, None), (1, "lines", 1, good, None), (2, "lines", 0, bad.replace("503", "5"), None), (2, "lines", 1, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, agent string, attempt int, response_text string, error string")
    got = {x["doc_id"]: x["lines_res"] for x in resolve_attempts(classify_attempts(df)).collect()}
    assert got[1].clientCases[0].durationHours == 2.0 and got[2] is None
