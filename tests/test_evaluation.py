"""Scoring against ground truth."""

from invoxa.operators.evaluation import accuracy_by_field, evaluate, final_score
from invoxa.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_truth_against_itself_scores_100(spark):
    t = fixtures.truth(spark, SF)
    gen = t.selectExpr("replace(filename, '.json', '.pdf') AS filename", "invoiceHeader",
                       "clientCases", "clientCasesNoActivity")
    s = evaluate(gen, t)
    r = final_score(s).first()
    assert r.n_evaluated == t.count() and r.final_score == 100.0
    assert all(x.accuracy == 1.0 for x in accuracy_by_field(s).collect())


def test_supplier_containment_and_missing(spark):
    t = fixtures.truth(spark, SF).limit(3)
    rows = t.collect()
    gen = t.selectExpr("replace(filename, '.json', '.pdf') AS filename",
                       "named_struct('supplierName', lower(invoiceHeader.supplierName) || ' extra', "
                       "'invoiceNumber', 'wrong', 'invoiceDate', invoiceHeader.invoiceDate, "
                       "'kvkNumber', invoiceHeader.kvkNumber, 'vatNumber', invoiceHeader.vatNumber) "
                       "AS invoiceHeader", "clientCases", "clientCasesNoActivity")
    gen = gen.where(f"filename <> '{rows[0].filename.replace('.json', '.pdf')}'")
    s = {r.truth_file: r for r in evaluate(gen, t).collect()}
    assert s[rows[0].filename].evaluated is False
    r1 = s[rows[1].filename]
    assert r1.points == 6 and r1.f_supplierName and not r1.f_invoiceNumber
    assert r1.report[0].startswith("❌ invoiceNumber mismatch: Expected '")
