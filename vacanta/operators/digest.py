"""The message sent for every relevant job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import format_skills
from ..functions.text import blank_to_null
from .numbering import number_rows

# Labels of the message lines.
LABELS = {
    "number": "📋 Job ",
    "title": "🏢 ",
    "company": "🏭 Company: ",
    "salary": "💰 Salary: ",
    "location": "📍 Location: ",
    "type": "⏰ Type: ",
    "must": "\n🔧 Must-have skills: ",
    "nice": "\n✨ Nice-to-have skills: ",
    "url": "\n🔗 URL: ",
}
NOT_AVAILABLE = "N/A"


def _or_na(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(NOT_AVAILABLE))


def _amount(c: str) -> Column:
    """A number as plain decimal text with at least one decimal, never in exponent form."""
    wide = F.regexp_replace(F.col(c).cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(c) < 1e7, F.col(c).cast("string")).otherwise(wide)


def digest_body() -> Column:
    """All lines of the message but the first."""
    top = F.when(
        F.coalesce(F.col("salary_max"), F.lit(0.0)) != 0,
        F.concat(F.lit(" - "), _amount("salary_max")),
    )
    low = F.when(F.col("salary_min").isNotNull(), _amount("salary_min")).otherwise(NOT_AVAILABLE)
    salary = F.when(
        F.coalesce("salary_min", "salary_max").isNotNull(),
        F.concat(
            F.lit(LABELS["salary"]),
            F.coalesce("salary_currency", F.lit("")),
            F.lit(" "),
            low,
            F.coalesce(top, F.lit("")),
        ),
    )
    remote = F.when(F.coalesce("is_remote", F.lit(False)), F.lit(" (Remote)")).otherwise("")
    location = F.when(
        F.col("location_region").isNotNull() | F.col("is_remote").isNotNull(),
        F.concat(F.lit(LABELS["location"]), _or_na("location_region"), remote),
    )

    def skills(c: str, label: str) -> Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(label), format_skills(c)))

    return F.concat_ws(
        "\n",
        F.concat(F.lit(LABELS["title"]), _or_na("title")),
        F.concat(F.lit(LABELS["company"]), _or_na("company_name")),
        salary,
        location,
        F.concat(F.lit(LABELS["type"]), blank_to_null("job_type")),
        skills("must_have_skills", LABELS["must"]),
        skills("nice_to_have_skills", LABELS["nice"]),
        F.concat(F.lit(LABELS["url"]), _or_na("source_url")),
    )


def job_digest(jobs: DataFrame, order: str = "arrival") -> DataFrame:
    """``(order, job_number, message)`` for the relevant jobs, numbered k of n."""
    lines = jobs.where("is_relevant").select(order, digest_body().alias("_body"))
    numbered = number_rows(lines, [order], name="job_number")
    total = numbered.agg(F.count("*")).scalar()
    head = F.concat(
        F.lit(LABELS["number"]),
        F.col("job_number").cast("string"),
        F.lit("/"),
        total.cast("string"),
        F.lit("\n\n"),
    )
    return numbered.select(order, "job_number", F.concat(head, "_body").alias("message"))


def search_summary(summary: DataFrame) -> DataFrame:
    """The closing message for a one-row run summary."""
    return summary.select(
        F.concat(
            F.lit("✅ Search completed!\n\n📊 Results:\n• Total scraped: "),
            F.col("total_scraped").cast("string"),
            F.lit("\n• Passed filters: "),
            F.col("total_filtered").cast("string"),
            F.lit("\n• Processed: "),
            F.col("total_processed").cast("string"),
            F.lit("\n• Relevant jobs: "),
            F.col("relevant").cast("string"),
            F.lit("\n\nSending relevant jobs..."),
        ).alias("message")
    )
