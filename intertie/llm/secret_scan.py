"""Secrets in texts: fixed patterns, and strings that look random to character models.

Two first-order Markov models of characters are trained, one on the values of
what the patterns find (labelled secrets), one on the other runs of the same
characters (ordinary identifiers and long words). A run is a secret if the
logarithm of its likelihood ratio exceeds a threshold. All of it is DataFrame
operations; the model is one table of pairs of characters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order of the report, and the patterns. ``access`` and ``hex`` ask for the least length in
# the pattern: within a run of their characters nothing else can match, so that equals dropping short matches.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN_LEAST = 16
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{RUN_LEAST},}}+"


def places(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Matches as structs (start, rank, end, value), leftmost and not overlapping.

    Starts follow from the lengths, in code points, of what lies between the
    matches. ``least`` drops matches whose ``group`` is shorter.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.transform(
        found,
        lambda m, i: F.struct(
            F.length(F.get(between, i)).alias("gap"), F.length(m).alias("size"), F.get(values, i).alias("value")
        ),
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda seen, p: F.struct(
            (seen["at"] + p["gap"] + p["size"]).alias("at"),
            F.concat(
                seen["out"],
                F.array(
                    F.struct(
                        (seen["at"] + p["gap"]).alias("start"),
                        F.lit(kind).alias("rank"),
                        (seen["at"] + p["gap"] + p["size"]).alias("end"),
                        p["value"].alias("value"),
                    )
                ),
            ).alias("out"),
        ),
        lambda seen: seen["out"],
    )
    kept = F.filter(walked, lambda m: F.length(m["value"]) >= least) if least else walked
    return F.when(text.rlike(pattern), kept).otherwise(none)


def located(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_base`` (matches of the patterns) and ``_runs`` (other runs of the alphabet), a null text empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    staged = docs.withColumn("_text", text).withColumns(
        {
            "_assign": places(F.col("_text"), ASSIGN, 0, ASSIGN_LEAST, 2),
            "_access": places(F.col("_text"), ACCESS, 1),
            "_hex": places(F.col("_text"), HEX, 2),
            "_run": places(F.col("_text"), RUN, 3),
        }
    )
    based = staged.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    apart = based.withColumn(
        "_runs",
        F.filter(
            "_run",
            lambda r: ~F.exists("_base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])),
        ),
    )
    return apart.drop("_text", "_assign", "_access", "_hex", "_run")


def pair_counts(labelled: DataFrame) -> DataFrame:
    """Counts of neighbouring characters: rows (``secret``, ``a``, ``b``, ``n``) from rows (``value``, ``secret``).

    ``a`` and ``b`` are places in the alphabet; at most two counts for each pair of characters.
    """
    pairs = labelled.select(
        "secret",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2))
            )
        ).alias("pair"),
    )
    # Counted by text first: a partial sum for each task, at most two for each pair.
    counted = pairs.groupBy("secret", "pair").agg(F.count("*").alias("n"))
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring("pair", i, 1)) - 1
    return counted.select("secret", place(1).alias("a"), place(2).alias("b"), "n").where("a >= 0 AND b >= 0")


def labelled_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Samples for training from all of ``docs``: values of the patterns are secrets, all other runs are ordinary."""
    found = located(docs.select(text_col), text_col)
    samples = found.select(
        F.explode(
            F.concat(
                F.transform("_base", lambda m: F.struct(m["value"].alias("value"), F.lit(True).alias("secret"))),
                F.transform("_runs", lambda m: F.struct(m["value"].alias("value"), F.lit(False).alias("secret"))),
            )
        ).alias("s")
    )
    return samples.select("s.value", "s.secret").where(F.length("value") >= 2)


def train(labelled: DataFrame, prior: float = 2.0) -> list[float]:
    """Logarithms of the ratio of the two models' transition probabilities, by pair of characters.

    A transition counts ``prior`` observations more, spread like the model's
    characters as a whole. The result has one number for each pair of the
    alphabet, however many samples there are. Without samples of one kind its model is uniform.
    """
    size = len(ALPHABET)
    counts = {True: [0] * (size * size), False: [0] * (size * size)}
    for row in pair_counts(labelled).collect():
        counts[row.secret][row.a * size + row.b] += row.n
    logs = {}
    for kind, pairs in counts.items():
        into = [sum(pairs[b::size]) + 0.5 for b in range(size)]
        share = [n / sum(into) for n in into]
        out_of = [sum(pairs[a * size : (a + 1) * size]) for a in range(size)]
        logs[kind] = [
            math.log((pairs[a * size + b] + prior * share[b]) / (out_of[a] + prior))
            for a in range(size) for b in range(size)
        ]
    return [x - y for x, y in zip(logs[True], logs[False])]


def likelihood_ratio(value: Column, ratio: list[float]) -> Column:
    """Logarithm of the ratio of the two models' likelihoods for a run of the alphabet."""
    table = F.expr("array(" + ",".join(f"{x:.6f}D" for x in ratio) + ")")
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    # The state is the last character (-1 before the first) and the sum so far.
    return F.aggregate(
        codes,
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda seen, c: F.struct(
            c.alias("last"),
            F.when(
                (seen["last"] >= 0) & (c >= 0),
                seen["sum"] + F.get(table, seen["last"] * F.lit(len(ALPHABET)) + c),
            ).otherwise(seen["sum"]).alias("sum"),
        ),
        lambda seen: seen["sum"],
    )


def find(docs: DataFrame, ratio: list[float], threshold: float = 12.0, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_spans``: arrays of structs (start, rank, end, value) in order of start and kind.

    ``_spans`` are those of ``_base`` and the runs whose likelihood ratio,
    as a logarithm, exceeds ``threshold``. A null or empty text has none.
    """
    found = located(docs, text_col)
    likely = found.withColumn(
        "_random", F.filter("_runs", lambda r: likelihood_ratio(r["value"], ratio) > F.lit(threshold))
    )
    return likely.withColumn("_spans", F.array_sort(F.concat("_base", "_random"))).drop("_runs", "_random")


def joined(spans: str) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ","
    )


def report(docs: DataFrame, threshold: float = 12.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans of every document, the models trained on all of ``docs``."""
    plain = docs.select(F.col(id_col), F.col(text_col))
    found = find(plain, train(labelled_runs(docs, text_col)), threshold, text_col)
    number = lambda kind: F.size(F.filter("_base", lambda m: m["rank"] == kind)).cast("long")
    return found.select(
        id_col,
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(joined("_base"), 256).alias("base_sha256"),
        joined("_spans").alias("spans"),
    )


def redact(docs: DataFrame, threshold: float = 12.0, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs``, same rows and columns, with every span of ``text_col`` replaced by ``mask``; overlapping spans by one.

    A text without spans, a null one too, stays as it is.
    """
    columns = docs.columns
    apart = docs.select(F.struct(*columns).alias("_row"), F.col(text_col))
    found = find(apart, train(labelled_runs(docs, text_col)), threshold, text_col)
    text = F.col(text_col)
    walked = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda seen, s: F.struct(
            F.greatest(seen["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= seen["at"],
                F.concat(
                    seen["out"], F.substring(text, seen["at"] + 1, s["start"] - seen["at"]), F.lit(mask)
                ),
            ).otherwise(seen["out"]).alias("out"),
        ),
        lambda seen: F.concat(seen["out"], F.substring(text, seen["at"] + 1, F.length(text))),
    )
    masked = F.when(F.size("_spans") > 0, walked).otherwise(text).alias(text_col)
    return found.select(*[masked if c == text_col else F.col("_row")[c].alias(c) for c in columns])
