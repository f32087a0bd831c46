"""Extractors by type on hand-written texts."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import extractors as ex
from paperloom.functions import text as tx
from paperloom.plans import queries

SF = "/root/testdata/sf0.001"

CASES = {
    "income_certificate": ("REVENUE DEPARTMENT\nCertificate No: Tn-4202807036380\nThis is to certify that Thiru Gopal N son of Thiru Nachimuthu residing at Door No. 2\nAvinashi Taluk\nTicuppur District\nRs. 78ooo/jnnum\nDale: 11/07/2023", {"Certificate Number": "TN-4202807036380", "Citizen Name": "Gopal N", "Father / Husband Name": "Nachimuthu", "Annual Income": "Rs. 78,000", "District": "Tiruppur", "Taluk": "Avinashi", "Issue Date": "11-07-2023"}),
    "birth_certificate": ("CERTIFICATE OF BIRTH\nCertificate Number: TN-GCC-BC-2026-3391\nChild Name: Ananya R\nDate of Birth: 01/02/2020\nFather's Name: Ravi K\nMother's Name: Uma\nPlace of Birth: Chennai\nDistrict: Chennai\nDate: 03/04/2021", {"Certificate Number": "TN-GCC-BC-2026-3391", "Citizen Name": "Ananya R", "Date of Birth": "01-02-2020", "Father's Name": "Ravi K", "Mother's Name": "Uma", "Place of Birth": "Chennai", "District": "Chennai", "Issue Date": "03-04-2021"}),
    "community_certificate": ("COMMUNITY CERTIFICATE\nThis is to certify that Selvan Boopathy son of Thiru Gopal residing at Door No. 2 belongs to Kongu Vellalars Community, which is recognized as a Backward Class as per order\nDate: 09-12-2019", {"Citizen Name": "Boopathy", "Father / Guardian": "Gopal", "Community": "Kongu Vellalars (Backward Class)", "Issue Date": "09-12-2019"}),
    "pan_card": ("INCOME TAX DEPARTMENT\nRAVI KUMAR\nMOHAN RAJ\n12/03/1980\nABCDE1234F", {"Certificate Number": "ABCDE1234F", "PAN Number": "ABCDE1234F", "Date of Birth": "12-03-1980", "Citizen Name": "RAVI KUMAR", "Father / Guardian": "MOHAN RAJ"}),
    "driving_licence": ("DRIVING LICENCE\nDL No: TN38 20110012345\nName: Suresh B\nS/O: Mohan\nDOB: 01/01/1990\nDate of Issue: 02-03-2011\nValid Till: 01-03-2031\nDistrict: Erode", {"Certificate Number": "TN38 20110012345", "Driving Licence Number": "TN38 20110012345", "Citizen Name": "Suresh B", "Father / Guardian": "Mohan", "Date of Birth": "01-01-1990", "Issue Date": "02-03-2011", "Valid Till": "01-03-2031", "District": "Erode"}),
    "aadhaar": ("  GOVERNMENT OF INDIA\n  Unique Identification Authority of India\nTo\nBoopathy\nS/O: Gopal, 2/208, Thalakarai,\nThandukarampalayam, Avinashi,\nDistrict: Tiruppur, PIN Code: 641655\nYour Aadhaar No. :\n3364 2270 6124\nVID : 9139 2849 7347 5468\nEnrolment No: 1234/56789/01234\nDOB: 28/9/2006\nMALE", {"VID": "9139 2849 7347 5468", "Aadhaar Number": "3364 2270 6124", "Enrolment Number": "1234/56789/01234", "Date of Birth": "28-09-2006", "Gender": "Male", "Citizen Name": "Boopathy", "Father / Guardian": "Gopal", "District": "Tiruppur", "PIN Code": "641655"}),
    "generic": ("STUDENT FORM\nName: Boopathy G\nRoll No: 24CSR044\nDOB: 28/09/2006", {"Citizen Name": "Boopathy G", "Roll Number": "24CSR044", "Date of Birth": "28-09-2006", "Issue Date": "28-09-2006"}),
}


@pytest.mark.parametrize("extractor", sorted(CASES))
def test_fields(spark, extractor):
    text, want = CASES[extractor]
    rows = spark.createDataFrame([(0, text), (1, None), (2, ""), (3, " \n ")], "id long, t string")
    got = {r.id: r.m for r in rows.select("id", ex.extract(extractor, F.col("t")).alias("m")).collect()}
    assert got == {0: want, 1: {}, 2: {}, 3: {}}


@pytest.mark.parametrize(
    ("text", "name", "father"),
    [
        ("AkileshS D/O: Mohan Raj 12", "Akilesh S", "Mohan Raj"), ("Boopathy 9p pmn/DOB: 28/09/2006", None, None), ("Boopathy /DOB: 28/09/2006", "Boopathy", None), ("Ananya R\nxx 12\nDOB 01-02-2003", "Ananya R", None), ("Ananya R\n12\n13\nDOB 01-02-2003", None, None),
        ("DOB is no proof of identity\nTo\nRavi K\nVellore Road\nW/O Ravi K,", "Ravi K", None), ("To S/O: Mani", None, "Mani"), ("Gapall\nDOB: 1/1/2001", "Gopal", None),
    ],
)
def test_card_names(spark, text, name, father):
    m = spark.createDataFrame([(text,)], "t string").select(ex.extract("aadhaar", F.col("t")).alias("m")).first().m
    assert (m.get("Citizen Name"), m.get("Father / Guardian")) == (name, father)


def test_close_district(spark):
    rows = spark.createDataFrame([("Ticuppur",), ("Salem",), ("Nowhere",), (None,)], "w string")
    got = rows.select("w", ex.close_district(F.col("w"), 0.7).alias("d")).collect()
    assert {r.w: r.d for r in got} == {"Ticuppur": "Tiruppur", "Salem": "Salem", "Nowhere": None, None: None}


@pytest.mark.parametrize("extractor", ["community_certificate", "driving_licence", "income_certificate", "pan_card"])
def test_each_pattern_is_searched_once(spark, extractor):
    plan = spark.createDataFrame([("",)], "t string").select(ex.extract(extractor, F.col("t")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp") <= 70  # 428, 520, 1,374 and 6,012 when each use of a value computed it anew


@pytest.mark.parametrize("name", ["extract_dl_card", "extract_income", "extract_pan_card"])
def test_one_file_is_spread_over_many_tasks(spark, name):
    assert queries.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 32  # 1 when the one task that read the orders extracted all


def test_districts_take_one_search(spark):
    rows = spark.createDataFrame([("Salem, near CHENNAI", "Chennai"), ("xSalem", None), ("ſalem", "Salem"), ("Theni-Erode", "Erode"), ("avinashi Taluk", "Tiruppur"), (None, None)], "t string, want string")
    found = rows.select("want", tx.district_in_text(F.col("t")).alias("d"))
    assert all(r.want == r.d for r in found.collect())
    assert found._jdf.queryExecution().analyzed().toString().lower().count("like") == 0  # 39 when each district was searched for by itself


def test_pan_lines_are_cleaned_once(spark):
    plan = spark.createDataFrame([("",)], "t string").select(ex.extract("pan_card", F.col("t")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("rcsiding") <= 5  # 7 when lines were cleaned to be judged and again to be names
