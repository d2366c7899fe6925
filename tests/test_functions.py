from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions import grammar, similarity, text, values


def over(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_company_names(spark):
    names = ["Test Company Ltd", "Test Company Ltd.", "Test Company LIMITED", "  Test Company  Ltd  ", "Big Corp PLC", "Big Corp P.L.C.", "Multiple   Spaces   Ltd", "", "   ", None]
    assert over(spark, text.company_name, names) == ["test company limited"] * 4 + ["big corp plc"] * 2 + ["multiple spaces limited", "", "", None]


def test_titles(spark):
    raw = ["HEALTH AND SAFETY AT WORK ETC ACT 1974", "control of substances hazardous to health regulations", "The CDM Regulations (2015)", "COSHH, 2002", "the", "Noise (and etc) order", "", None]
    want = ["Health and Safety at Work etc. Act", "Control of Substances Hazardous to Health Regulations", "Construction (Design and Management) Regulations", "Control of Substances Hazardous to Health", "The", "Noise (and etc.) Order", "", None]
    assert over(spark, text.legislation_title, raw) == want
    assert over(spark, text.title_year, ["Health and Safety at Work Act 1974", "Some Act without year", "12345"]) == [1974, None, None]
    got = over(spark, text.legislation_url, ["https://www.legislation.gov.uk/ukpga/1974/37", "invalid-url"])
    assert tuple(got[0]) == ("ukpga", 1974, "37") and got[1] is None


def test_breaches(spark):
    got = over(spark, grammar.breach, ["Health and Safety at Work etc Act 1974, Section 2(1)", "Work at Height Regulations 2005, Regulation 4(1) and 6", "Fine: £5,000.50 for nothing", None])
    assert tuple(got[0])[1:5] == ("Health and Safety at Work etc Act 1974, Section 2(1)", "Section 2(1)", "Health and Safety at Work etc Act 1974", 1974)
    assert got[1].part == "Regulation 4(1) and 6"
    assert got[2].fine == Decimal("5000.50") and got[2].reference is None
    assert over(spark, text.breaches, ["a; b ;; c", ""]) == [["a", "b", "c"], []]


def test_penalties(spark):
    got = over(spark, grammar.components, ["The company was fined £500 and ordered to pay costs of £300.", "A £1,200.50 fine, £300 costs and a £120 victim surcharge", "fine of £90; victim surcharge of £32 and prosecution costs: £1,000", "6 months in prison and 200 hours of unpaid work", "10 weeks suspended, then 3 months custody", "nothing", "", None])
    rows = [r and tuple(None if x is None else float(x) if isinstance(x, Decimal) else x for x in r) for r in got]
    assert rows == [
        (500.0, 300.0, None, None, None, 800.0),
        (1200.5, 300.0, 120.0, None, None, 1620.5),
        (90.0, 1000.0, 32.0, None, None, 1122.0),
        (None, None, None, "6 months in prison", 200, None),
        (None, None, None, "3 months custody", None, None),
        *[(None,) * 6] * 3,
    ]
    got = over(spark, grammar.sentence, ["£2,000 fine; 2 years imprisonment suspended for 18 months", "12 month community order and 120 hours community service", "community order for 6 months", None])
    assert [r and tuple(r) for r in got] == [(Decimal("2000.00"), 24, 18, None, None), (None, None, None, 12, 120), (None, None, None, 6, None), None]
    assert over(spark, grammar.court, ["He appeared at Southampton Magistrates' Court on Monday", "At Hull Crown Court, she", "in court", None]) == ["Southampton Magistrates' Court", "Hull Crown Court", None, None]
    assert [r and tuple(r) for r in over(spark, grammar.defendant, ["John Smith, 45, of Port Town, was", "Jo Ray, aged 30, of Hull.", "Acme Ltd, of Leeds", "No one", None])] == [("John Smith", 45, "Port Town"), ("Jo Ray", 30, "Hull"), ("Acme Ltd", None, "Leeds"), (None,) * 3, None]


def test_citations(spark):
    got = over(spark, grammar.citations, ["Pleaded guilty to Section 2(1) of the Health and Safety at Work etc. Act 1974 and Regulations 4 and 6(2) of the Workplace (Health, Safety and Welfare) Regulations 1992. Fined", "Merchant Shipping Act 1995, Section 98, contrary to section 98", "no law", None])
    assert [[tuple(x) for x in r] for r in got] == [
        [("Section 2(1)", "Health and Safety at Work etc. Act 1974"), ("Regulation 4 and 6(2)", "Workplace (Health, Safety and Welfare) Regulations 1992")],
        [("Section 98", "Merchant Shipping Act 1995")],
        [],
        [],
    ]
    got = over(spark, grammar.breach, ["Town Act 1990, Article 3, Regulation 5 and Section 7A", "Rule 8", "  "])
    assert [tuple(r)[1:] for r in got] == [("Town Act 1990, Article 3, Regulation 5 and Section 7A", "Section 7A", "Town Act 1990", 1990, None), (None, "Rule 8", None, None, None), (None,) * 5]


def test_names_and_numbers(spark):
    assert over(spark, text.business_type, ["Smith LLC", "Acme Inc", "Big Corp. Co", "X PLC", "Y Ltd", "Z LLP", "John Smith"]) == ["LLC", "INC", "CORP", "PLC", "LTD", "LLP", "SOLE"]
    assert over(spark, text.company_number, ["03353423 (opens in new tab)", "3523081", "SC123456", " ", None]) == ["03353423", "03523081", "SC123456", None, None]
    assert over(spark, text.ordinal, ["First", "twentieth", "none"]) == [1, 20, None]
    assert over(spark, text.find_postcode, ["1 High St, London SW1A 1AA", "nowhere"]) == ["SW1A1AA", None]
    got = over(spark, text.industry, ["construction", "a maker of things", "food processing and chemical production for the whole country", None])
    assert got[0].industry == "Construction" and got[0].confidence == pytest.approx(0.95 * 0.95)
    assert got[1].industry is None and got[1].needs_review
    assert got[2].industry == "Manufacturing" and got[2].confidence == pytest.approx(0.99)
    assert got[3].industry is None


def test_dates(spark):
    raw = ["23/10/2025", "2025-10-23", "23-10-2025", "23 October 2025", "5/1/2024", "31/02/2024", "invalid", "", None]
    assert over(spark, values.parse_date, raw) == [date(2025, 10, 23)] * 4 + [date(2024, 1, 5)] + [None] * 4
    assert over(spark, values.parse_ordinal_date, ["On and before 3rd May 2024", "1st June 2023"]) == [date(2024, 5, 3), date(2023, 6, 1)]
    assert over(spark, lambda c: values.period_label(c, "week"), [date(2024, 1, 1), date(2024, 1, 7), date(2023, 1, 1), None], "date") == ["2024-W01", "2024-W02", "2023-W01", None]


def test_money(spark):
    assert over(spark, values.money, ["£1,234.50 fine", "none", None]) == [Decimal("1234.50"), Decimal("0.00"), Decimal("0.00")]
    assert over(spark, values.money_or_null, ["£3.75 million", "£5,000", "5000", None]) == [Decimal("3750000.00"), Decimal("5000.00"), None, None]
    assert over(spark, values.clean_fine, ["£ 2,000", "x", None]) == [Decimal("2000.00"), Decimal(0), Decimal(0)]


def test_short_numbers(spark):
    got = over(spark, values.short_number, [358650.0, 405950.0, 999950.0, 1250.0, 1750.0, 1350.0, 1e6, 2_450_000.0, 999.5, 999.0, 0.0, 12_345_678_900.0, None], "double")
    assert got == ["358.6K", "405.9K", "1000.0K", "1.3K", "1.8K", "1.4K", "1.0M", "2.5M", "999.5", "999", "0", "12345.7M", None]


def test_similarity(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("dixon", "dicksonx"), ("", "a"), ("same", "same"), (None, "a")], "a string, b string")
    got = [r.j for r in df.select(similarity.jaro("a", "b").alias("j")).collect()]
    assert got[:2] == [pytest.approx(0.9444, abs=1e-4), pytest.approx(0.7667, abs=1e-4)] and got[2:] == [0.0, 1.0, None]
    assert over(spark, lambda c: similarity.trigram_similarity(c, F.lit("two words")), ["word"]) == [pytest.approx(4 / 11)]
