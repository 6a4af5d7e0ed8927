"""years of experience that texts require; expected numbers are read off the rule."""

import pytest
from pyspark.sql import functions as F

from rowloom.operators import years

READ = {
    "5+ years of hands-on software work with Java.": 5,
    "You have 4+ years of experience in testing": 4,
    "Experience: 12+ Years": 12,
    "8â10+ years of professional experience": 8,
    "Experience: 3-10 years building things": 3,
    "At least two years of professional experience": 2,
    "1.5 years of experience with React": 1,
    "6 to 8 years of software engineering": 6,
    "Requires 5+ years of software experience.": 5,
    "4-6 years of experience": 4,
    "Call 555.010.0199. Requires 3 years of experience.": 3,
    "Bachelor's degree and 3+ years of experience": 3,
    "Bachelor's degree or equivalent experience with 5+ years of software engineering experience": 5,
    "minimum 7 years of engineering, or 2 years of experience with Go": 2,
    "7+ years of Java development. 3+ years of experience with Spring.": 7,
    "5 years of experience, or 2 years of experience with a Master's degree.": 2,
    "2+ years of experience required; 6+ years of experience is a plus.": 2,
    "8+ years of Java": 8,
    "- 5 years of Python": 5,
    "2 years required": 2,
    "Years of experience: 4": 4,
    "Qualifications:\n6 years of Go\nBenefits\n- 3 years of service award experience": 6,
    "5 years of experience\nOR\n3 years of experience": 3,
    "Requirements<br>7+ years with Go</li>": 7,
    "4+ years of experience in finance, preferably with pricing": 4,
}
NOT_READ = [
    "With 40+ years of experience in the game, we're not just building software.",
    "A company with more than 18 years of experience helping others build teams.",
    "Applicants must be 18 years or older.",
    "Our 401(k) vests over 4 years.",
    "Founded 15 years ago, we have grown.",
    "With over 100 years of experience in 30 countries.",
    "Bachelor's degree or equivalent (minimum 12 years) work experience",
    "(If Associate's Degree, must have minimum 6 years work experience)",
    "5+ years of experience preferred.",
    "Nice to have:\n- 6 years of Rust experience",
    "Best place to work 8 years in a row, with a strong engineering culture",
    "15+ years in business, Acme leads in software",
    "We value curiosity",
    "5 years of Java",
    "",
    None,
    "years years years",
]


def values(spark, texts, company=""):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["y"] for r in df.select("i", years.required_years(F.col("t"), F.lit(company)).alias("y")).orderBy("i").collect()]


def test_requirements_are_read(spark):
    assert dict(zip(READ, values(spark, list(READ)), strict=True)) == READ


def test_other_years_are_not(spark):
    assert dict(zip(NOT_READ, values(spark, NOT_READ), strict=True)) == dict.fromkeys(NOT_READ)


@pytest.mark.parametrize("company, wanted", [("Genesis Works", None), ("Other", 12)])
def test_years_after_the_company_are_its_own(spark, company, wanted):
    assert values(spark, ["working with Genesis for 12 years on software engineering"], company) == [wanted]


def test_sections_of_many_lines_take_one_step_a_line(spark):
    """Headings among lines of text: each line has the section of the last one, found in one pass over headings and years."""
    filler = "plain words of a line that says nothing\n" * 400
    texts = [
        filler + "WHAT YOU BRING\n" + filler + "- 5 years of Go\n" + filler + "Nice to have:\n" + filler + "9 years of experience\n",
        filler + "Requirements\n" + "- 3 years of Go\n" + filler + "or\n" + filler + "- 2 years of Rust\n",
        filler + "(Preferred)\n" + filler + "7 years of experience\n" + "Who we are\n" + "4 years of experience\n",
        filler + "Per\u212as:\n- 8 years of Go",
        ("Requirements:\n- 6 years of Go\nBenefits:\n- 9 years of tea\n") * 300,
    ]
    assert values(spark, texts) == [5, 2, 4, None, 6]
    plan = spark.createDataFrame([("x",)], "t string").select(years.required_years(F.col("t"), F.lit("")))._jdf.queryExecution().optimizedPlan().toString()
    assert ".i <" not in plan and "[i]" not in plan


def test_reason(spark):
    df = spark.createDataFrame([("Engineer", "6+ years of experience", "c"), ("Engineer", "2 years of experience", "c"), (None, None, None)], "t string, d string, c string")
    assert [r[0] for r in df.select(years.years_reason(F.col("t"), F.col("d"), F.col("c"), 3)).collect()] == ["requires 6+ years (max 3)", None, None]
