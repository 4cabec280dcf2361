"""Prompt assembly, generation, response checking and fallback.

Candidates arrive as ordered arrays (the list form of ``knn_join``), so the
prompt needs no aggregation: ``array_join`` over at most k elements per row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from .calls import Retry, answers, at_most

# List formatting of candidates inside the prompt.
DESCRIPTION_PREFIX = "## "
DESCRIPTION_SEPARATOR = "\n\n## "
CODE_SEPARATOR = ", "
REQUIRED_KEYS = ("nace_code", "codable", "confidence")

SYSTEM_PROMPT = (
    "You code short descriptions of economic activities with a hierarchical "
    "classification. Pick exactly one code from the candidate list, or none when the "
    "description is too vague. Reply with one JSON object with the keys nace_code "
    "(string or null), codable (boolean) and confidence (number from 0 to 1)."
)
USER_TEMPLATE = (
    "Activity to code: {activity}\n\n"
    "Candidate entries:\n{descriptions}\n\n"
    "Candidate codes: {codes}"
)

Generator = Callable[[Sequence[str], Sequence[str]], Sequence[str]]


def _fill(template: str, values: dict[str, Column]) -> Column:
    """replace ``{name}`` slots of a template with column values."""
    # Cut the template at its own slots, so that braces inside a value stay text.
    parts = re.split("({" + "}|{".join(map(re.escape, values)) + "})", template)
    return F.concat(*[F.coalesce(values[p[1:-1]], F.lit("")) if i % 2 else F.lit(p)
                      for i, p in enumerate(parts)])


def build_prompts(df: DataFrame, activity: str, texts: str = "texts", codes: str = "codes",
                  system_prompt: str = SYSTEM_PROMPT, user_template: str = USER_TEMPLATE
                  ) -> DataFrame:
    """``system``, ``user`` and ``codes_list`` columns from ordered candidate arrays."""
    descriptions = F.concat(F.lit(DESCRIPTION_PREFIX),
                            F.array_join(F.col(texts), DESCRIPTION_SEPARATOR))
    codes_list = F.array_join(F.col(codes), CODE_SEPARATOR)
    return (df.withColumn("codes_list", codes_list)
            .withColumn("system", F.lit(system_prompt))
            .withColumn("user", _fill(user_template, {"activity": F.col(activity),
                                                      "descriptions": descriptions,
                                                      "codes": codes_list})))


def top_candidate_response(codes: str = "codes", scores: str = "scores") -> Column:
    """G5 offline default: rank-1 candidate with its score, as a JSON response."""
    top = F.get(F.col(codes), 0)
    return F.to_json(F.struct(top.alias("nace_code"), top.isNotNull().alias("codable"),
                              F.round(F.coalesce(F.get(F.col(scores), 0), F.lit(0.0)), 6)
                              .alias("confidence")), {"ignoreNullFields": "false"})


def generate(df: DataFrame, generator: Generator, system: str = "system", user: str = "user",
             out_col: str = "response", retry: Retry = Retry(), concurrent: int | None = None) -> DataFrame:
    """G5 with a pluggable model: ``generator(systems, users) -> responses`` per Arrow batch.

    A batch that fails (after ``retry``) is halved down to the failing rows: a row that fails alone has
    a null response and ``gen_error`` set, the others keep their answers (G6 handles the rest).
    ``concurrent`` bounds the calls that run at a time.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType()),
                                              T.StructField("gen_error", T.StringType())])

    def call(rows):
        return generator([s for s, _ in rows], [u for _, u in rows])

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = list(zip(batch.column(system).to_pylist(), batch.column(user).to_pylist(), strict=True))
            resp, err = answers(call, rows, retry)
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + [pa.array(resp, pa.string()), pa.array(err, pa.string())],
                names=list(batch.schema.names) + [out_col, "gen_error"])

    return at_most(df, concurrent).mapInArrow(run, schema)


_TRUE = ("true", "1", "yes", "on", "t", "y")
_FALSE = ("false", "0", "no", "off", "f", "n")


def parse_response(col: str = "response") -> Column:
    """Struct ``nace_code, codable, confidence, error`` from a JSON response.

    Rules: the text without white space around it must be one JSON object (nothing after its closing
    brace); keys ``nace_code``, ``codable`` and ``confidence`` must be present;
    ``nace_code`` a JSON string or null; ``codable`` a boolean (or a boolean word);
    ``confidence`` a number (or numeric text) within [0, 1]. ``error`` names
    the first broken rule, values are null then.
    """
    txt = strip(F.col(col))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(txt), "$.nace_code", "variant"))
    keys = F.json_object_keys(txt)
    parsed = F.from_json(txt, "nace_code string, codable string, confidence string")
    codable_s = F.lower(F.trim(parsed["codable"]))
    codable = (F.when(codable_s.isin(*_TRUE), F.lit(True))
               .when(codable_s.isin(*_FALSE), F.lit(False)))
    conf = parsed["confidence"].try_cast("double")
    missing = [F.when(~F.array_contains(keys, k), F.lit(f"missing key: {k}")) for k in REQUIRED_KEYS]
    err = (F.when(F.col(col).isNull(), F.lit("no response"))
           .when(~txt.startswith("{") | ~txt.endswith("}") | keys.isNull(),
                 F.lit("not a JSON object")))
    err = F.coalesce(err, *missing,
                     F.when(~kind.isin("STRING", "VOID"), F.lit("nace_code is not text")),
                     F.when(codable.isNull(), F.lit("codable is not a boolean")),
                     F.when(conf.isNull(), F.lit("confidence is not a number")),
                     F.when(~conf.between(0.0, 1.0), F.lit("confidence out of range")))
    ok = err.isNull()
    return F.struct(F.when(ok, parsed["nace_code"]).alias("nace_code"),
                    F.when(ok, codable).alias("codable"),
                    F.when(ok, conf).alias("confidence"), err.alias("error"))


def apply_fallback(df: DataFrame, parsed: str = "parsed", codes: str = "codes",
                   reference_fallback: bool = False) -> DataFrame:
    """Decision columns ``pred_code, codable, confidence, retrieved_codes, error``.

    A row whose response failed gets no code, ``codable`` false and confidence
    0. By default its candidates are kept (so it still counts as a retriever
    hit when the truth was retrieved); ``reference_fallback=True`` also empties
    the candidate list, as the reference does.
    """
    p = F.col(parsed)
    failed = p["error"].isNotNull()
    cands = F.coalesce(F.col(codes), F.array().cast("array<string>"))
    if reference_fallback:
        cands = F.when(failed, F.array().cast("array<string>")).otherwise(cands)
    return (df.withColumn("pred_code", F.when(~failed, p["nace_code"]))
            .withColumn("codable", F.coalesce(F.when(~failed, p["codable"]), F.lit(False)))
            .withColumn("confidence", F.coalesce(F.when(~failed, p["confidence"]), F.lit(0.0)))
            .withColumn("retrieved_codes", cands)
            .withColumn("error", p["error"]))
