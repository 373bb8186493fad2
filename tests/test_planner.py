"""Search lines and what they are read as."""

from datetime import datetime

import pytest

from siltstone.operators.planner import QueryPlan, plan_query, refine

NOW = datetime(2026, 7, 28, 9, 30)
D = datetime


@pytest.mark.parametrize(("line", "text", "extensions", "folder", "after", "before"), [
    ("il pdf del contratto di marzo", "contratto", ("pdf",), "", D(2026, 3, 1), D(2026, 4, 1)),
    ("contratto noleggio", "contratto noleggio", (), "", None, None),
    ("tipo:xlsx tasse", "tasse", ("xlsx",), "", None, None),
    ("foto", "foto", ("jpg", "jpeg", "png", "gif", "webp", "heic", "bmp"), "", None, None),
    ("This Is Us", "this is us", (), "", None, None),
    ("la casa", "la casa", (), "", None, None),
    ("where is the spreadsheet with the invoices", "invoices", ("xls", "xlsx", "ods", "csv"), "", None, None),
    ("la fattura, in pdf, di ieri?", "fattura", ("pdf",), "", D(2026, 7, 27), D(2026, 7, 28)),
    ("relazione 2024", "relazione", (), "", D(2024, 1, 1), D(2025, 1, 1)),
    ("modulo 1234", "modulo 1234", (), "", None, None),
    ("report from downloads", "report", (), "\\downloads\\", None, None),
    ("notes last week", "notes", (), "", D(2026, 7, 20), D(2026, 7, 27)),
    ("notes december", "notes", (), "", D(2025, 12, 1), D(2026, 1, 1)),
    ("notes last month", "notes", (), "", D(2026, 6, 1), D(2026, 7, 1)),
    ("", "", (), "", None, None),
    ("?!", "?!", (), "", None, None)])
def test_lines(line, text, extensions, folder, after, before):
    assert plan_query(line, NOW) == QueryPlan(text, line, extensions, folder, after, before)


def test_refining_counts_whole_or_not_at_all():
    p = plan_query("show invoices sent by plumber", NOW)
    ask = lambda **a: lambda q: a
    assert refine(p, ask(subject="invoices plumber", format="pdf", when="last month"), NOW).extensions == ("pdf",)
    for bad in ({"subject": "boiler"}, {"subject": "invoices"}, {"subject": "invoices plumber", "format": "odd"}, {"subject": "invoices plumber", "when": "soon"}, {}):
        assert refine(p, ask(**bad), NOW) is p
    assert refine(p, lambda q: None, NOW) is p
