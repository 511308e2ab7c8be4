"""A checker's raw answers read into statuses, and failures into classes and kinds. Column expressions only."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "time double, error string, diagnostics struct<memory_max:bigint>, response struct<message:string,messages:array<struct<severity:string,data:string>>,sorries:array<string>>"

# Statuses, axioms, classes and the patterns that decide them.
VERIFIED, NO_ANSWER, TIMEOUT, SERVER_ERROR, LEAN_ERROR, USES_SORRY, FORBIDDEN_AXIOM, REJECTED_LEXICAL = "verified", "no_answer", "timeout", "server_error", "lean_error", "uses_sorry", "forbidden_axiom", "rejected_lexical"
ALLOWED_AXIOMS = ["propext", "Classical.choice", "Quot.sound"]
UNKNOWN_IDENTIFIER, OTHER_ERROR = "unknown_identifier", "other_error"
FAILURE_CLASSES = [UNKNOWN_IDENTIFIER, OTHER_ERROR, TIMEOUT, REJECTED_LEXICAL]
UNKNOWN = r"(?i)\bunknown (?:identifier|constant|namespace)\b|the environment does not contain"


@dataclass(frozen=True)
class Pin:
    """Rules of one checker version."""

    pin: str
    failed_warning_is_error: bool
    imports_above_comments: bool
    membership_binders_only: bool
    statements_from_pin: str | None = None


# The versions' rules.
PINS = {p.pin: p for p in (Pin("v4.9", True, False, False), Pin("v4.27", False, True, True, "v4.9"))}


def pin(name: str) -> Pin:
    if name not in PINS:
        raise ValueError(f"no pin {name!r}: there are {', '.join(sorted(PINS))}")
    return PINS[name]


def pins(spark: SparkSession) -> DataFrame:
    """The rules as a table of one row a version, small enough to broadcast."""
    return spark.createDataFrame([tuple(asdict(p).values()) for p in PINS.values()], "pin string, failed_warning_is_error boolean, imports_above_comments boolean, membership_binders_only boolean, statements_from_pin string")


def parsed(raw: Column) -> Column:
    return F.from_json(raw, ANSWER)


def classified(answer: Column, failed_warning_is_error: Column) -> Column:
    """struct<status, axioms> of a parsed answer; the first rule that matches decides.

    error: a time-out of the checker, else the server's. No response: the server's. A response with a message of its own
    only, an error message, or a warning of failure where the version counts it: lean_error. Then sorry, then axioms: no
    report, or one outside the allowed ones.
    """
    error, response = answer["error"], answer["response"]
    texts = lambda kind: F.transform(F.filter(F.coalesce(response["messages"], F.array().cast("array<struct<severity:string,data:string>>")), lambda m: m["severity"] == kind), lambda m: F.coalesce(m["data"], F.lit("")))
    holds = lambda kind, what: F.exists(texts(kind), lambda t: t.contains(what))
    report = F.get(F.filter(F.transform(texts("info"), lambda t: F.when(t.rlike(r"(?s)depends on axioms:\s*\[[^\]]*\]"), F.regexp_extract(t, r"(?s)depends on axioms:\s*\[([^\]]*)\]", 1)).when(t.contains("does not depend on any axioms"), "")), lambda t: t.isNotNull()), 0)
    axioms = F.array_sort(F.filter(F.transform(F.split(report, ","), lambda a: F.trim(F.regexp_replace(a, r"\s+", " "))), lambda a: a != ""))
    allowed = F.array(*[F.lit(a) for a in ALLOWED_AXIOMS])
    status = (
        F.when(error.isNotNull() & (error != ""), F.when(error.startswith("Lean REPL") & error.contains("timed out"), TIMEOUT).otherwise(SERVER_ERROR))
        .when(response.isNull(), SERVER_ERROR)
        .when(response["message"].isNotNull() & response["messages"].isNull(), LEAN_ERROR)
        .when((F.size(texts("error")) > 0) | (failed_warning_is_error & holds("warning", "failed")), LEAN_ERROR)
        .when((F.size(F.coalesce(response["sorries"], F.array().cast("array<string>"))) > 0) | holds("warning", "declaration uses 'sorry'"), USES_SORRY)
        .when(report.isNull() | (F.size(F.array_except(axioms, allowed)) > 0), FORBIDDEN_AXIOM)
        .otherwise(VERIFIED)
    )
    return F.struct(status.alias("status"), F.when(status.isin(VERIFIED, FORBIDDEN_AXIOM), axioms).alias("axioms"))


def error_texts(answer: Column) -> Column:
    messages = F.coalesce(answer["response"]["messages"], F.array().cast("array<struct<severity:string,data:string>>"))
    return F.transform(F.filter(messages, lambda m: m["severity"] == "error"), lambda m: F.coalesce(m["data"], F.lit("")))


def attempt_status(status: Column, detail: Column) -> Column:
    """A time-out of the header is no answer about the attempt, and so is an error of the server."""
    return F.when((status == TIMEOUT) & detail.contains("header command timed out"), NO_ANSWER).when(status == SERVER_ERROR, NO_ANSWER).otherwise(status)


def without_echoes(errors: Column, name: Column) -> Column:
    """Messages but for those that only say that the attempt's own theorem is not there."""
    return F.filter(errors, lambda e: ~F.regexp_like(e, F.concat(F.lit(r"(?i)\bunknown (?:identifier|constant)\s+([`'])\Q"), name, F.lit(r"\E\1"))))


def names_unknown(message: Column) -> Column:
    return message.rlike(UNKNOWN)


def failure_class(status: Column, errors: Column) -> Column:
    """Null for what verified or got no answer; an error is an unknown identifier if any message names something unknown."""
    return (
        F.when(status.isin(VERIFIED, NO_ANSWER), F.lit(None).cast("string")).when(status.isin(TIMEOUT, REJECTED_LEXICAL), status)
        .when(F.exists(F.coalesce(errors, F.array().cast("array<string>")), names_unknown), UNKNOWN_IDENTIFIER).otherwise(OTHER_ERROR)
    )


def error_kind(message: Column) -> Column:
    """The first line with quoted names as _, its first 80 characters, without colons and spaces at the end."""
    line = F.get(F.split(F.btrim(message, F.lit(" \t\n\r\x0b\x0c")), "\n"), 0)
    return F.rtrim(F.substring(F.regexp_replace(line, "`[^`]*`|'[^']*'|«[^»]*»", "_"), 1, 80), F.lit(": "))


def deciding_error(errors: Column, detail: Column) -> Column:
    return F.coalesce(F.get(F.filter(errors, names_unknown), 0), F.get(errors, 0), detail)


def band_label(rate: Column, edges: list[float]) -> Column:
    """0, then (a, b] between the edges up to 1."""
    bounds = [0.0, *edges, 1.0]
    label = F.when(rate <= 0, F.lit("0"))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        label = label.when(rate <= b, F.lit(f"({a:g}, {b:g}]"))
    return label.when(rate.isNotNull(), F.lit(f"({bounds[-2]:g}, 1]"))


def stratum(side: Column, kind: Column, source: Column, proof: Column, mark: str = "published_for_every_value") -> Column:
    """Stratum of a certificate: a disproof by whether it wraps variables, a conjecture, else its source."""
    names = {"internlm_proofs": "internlm_proofs", "internlm_rows": "internlm_rows_proved", "goedel": "goedel", "stp": "stp_statement"}  # fixed values
    of_source = F.lit(None).cast("string")
    for s, name in names.items():
        of_source = F.when(source == s, F.lit(name)).otherwise(of_source)
    return F.when(side == "known_false", F.when(proof.contains(mark), "disproved_with_variables").otherwise("disproved_no_variables")).when(kind == "stp_conjecture", "stp_conjecture").otherwise(of_source)
