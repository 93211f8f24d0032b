"""Type, kind, target and task inference. Every column is judged in the same pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.dates import parse_date, time_of_day
from tabwright.functions.numbers import NUMBER, finite, is_integral, parse_bool, parse_number, parse_number_loose, to_int
from tabwright.functions.text import PLACEHOLDERS, clean_text, name_tokens, normalized
from tabwright.functions.units import CLOCK_SHAPE, DURATION_SHAPE
from tabwright.operators.profile import per_column
from tabwright.operators.scale import col, local_frame
from tabwright.operators.valuecounts import distinct_counts, is_numeric, is_time, long_values, value_count_table

MONEY_SHAPE = r"^[$€£₹¥]\s*-?[0-9][0-9,]*(\.[0-9]+)?$"
PERCENT_SHAPE = r"^-?[0-9][0-9,]*(\.[0-9]+)?\s*%$"
DATE_WORDS = ["date", "time", "timestamp", "dt"]
ID_WORDS = ["id", "ids", "key", "phone", "mobile", "zip", "zipcode", "postcode", "pincode", "account"]

# Statement words that point to a task, and name words of likely targets.
CLASSIFICATION_HINTS = ["class", "classification", "churn", "default", "fraud", "yes/no", "binary", "category"]
REGRESSION_HINTS = ["price", "amount", "cost", "revenue", "sales", "score", "predict", "forecast", "regression"]
TARGET_PRIORITY = ["target", "label", "class", "outcome", "price", "sales", "amount", "y"]
TASKS = ["regression", "classification", "clustering"]


def text_stats(long: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """Aggregate statistics of a long (column, value) table per column.

    The parse rules then compile once, on one value column, however many columns there are.
    """
    return long.groupBy("column").agg(*[e.alias(k) for k, e in stats.items()])


def recommend_types(df: DataFrame, rules: str = "basic") -> DataFrame:
    """(column, dtype): object, integer, float, date or boolean.

    ``basic``: nine tenths of the values must read as numbers, else as day-first dates.
    ``rich`` first drops placeholders and keeps as object what only looks like a number:
    leading zeros, identifiers, durations and numbers mixed with words; currency and percent
    text is float, yes/no text is boolean.
    """
    spark = df.sparkSession
    known, numeric, text = [], [], []
    ids = [c for c in df.columns if rules == "rich" and set(name_tokens(c)) & set(ID_WORDS)]
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            known.append((f.name, "boolean"))
        elif is_time(f.dataType):
            known.append((f.name, "date"))
        elif is_numeric(f.dataType):
            known.append((f.name, "object")) if f.name in ids else numeric.append(f.name)
        elif f.name in ids:
            known.append((f.name, "object"))
        else:
            text.append(f.name)
    out = local_frame(spark, known, "column string, dtype string")
    if numeric:
        whole = per_column(df, {
            c: {"n": F.count(finite(col(c))), "whole": F.coalesce(is_integral(finite(col(c))), F.lit(False))} for c in numeric
        })
        dtype = F.when(F.col("n") == 0, "object").when(F.col("whole"), "integer").otherwise("float")
        out = out.unionByName(whole.select("column", dtype.alias("dtype")))
    if text:
        out = out.unionByName(_text_types(long_values(df, text), rules))
    return out


def _text_types(long: DataFrame, rules: str) -> DataFrame:
    share = lambda name: F.col(name) / F.greatest(F.col("filled"), F.lit(1)) >= 0.9
    v = F.col("value")
    if rules == "rich":
        trimmed = long.select("column", F.trim("value").alias("value"))
        long = trimmed.withColumn("value", F.when(~F.lower("value").isin(PLACEHOLDERS), v)).withColumn("low", F.lower("value"))
        low = F.col("low")
        found = text_stats(long, {
            "filled": F.count("value"),
            "flags": F.count(parse_bool(low, cleaned=True)),
            "money": F.count_if(low.rlike(MONEY_SHAPE) | low.rlike(PERCENT_SHAPE)),
            "zero_led": F.count_if(low.rlike("^0[0-9]+$")),
            "durations": F.count_if(low.rlike(CLOCK_SHAPE) | low.rlike(DURATION_SHAPE)),
            "strict": F.count_if(F.replace(low, F.lit(","), F.lit("")).rlike(NUMBER)),
            "integral": F.coalesce(is_integral(parse_number_loose(F.when(~low.contains("e"), low))), F.lit(False)) & (F.count_if(low.contains("e")) == 0),
            "dates": F.count(parse_date(v, dayfirst=True)),
        })
        dtype = (
            F.when(F.col("filled") == 0, "object")
            .when(F.col("flags") == F.col("filled"), "boolean")
            .when((F.col("zero_led") > 0) | (F.col("durations") > 0), "object")
            .when(share("money"), "float")
            .when(share("strict"), F.when(F.col("integral"), "integer").otherwise("float"))
            .when(share("dates"), "date")
        )
    else:
        staged = long.select("column", "value", parse_number_loose(v).alias("loose"), clean_text(v).alias("clean"))
        found = text_stats(staged, {
            "filled": F.count("value"), "numeric": F.count("loose"),
            "integral": F.coalesce(is_integral(F.col("loose")), F.lit(False)),
            "dates": F.count(parse_date(F.col("clean"), dayfirst=True)),
        })
        dtype = (
            F.when(F.col("filled") == 0, "object")
            .when(share("numeric"), F.when(F.col("integral"), "integer").otherwise("float"))
            .when(share("dates"), "date")
        )
    return found.select("column", dtype.otherwise("object").alias("dtype"))


def infer_kinds(
    df: DataFrame, bool_ratio: float = 0.98, date_ratio: float = 0.9, number_ratio: float = 0.9, hinted_date_ratio: float = 0.5, compose: bool = True,
) -> DataFrame:
    """(column, kind): boolean, numeric, datetime or categorical, by type or by what the text reads as.

    Text is composed and read as the cleaner does, each distinct value once.
    """
    fixed, text = fixed_kinds(df)
    out = local_frame(df.sparkSession, fixed, "column string, kind string")
    if not text:
        return out
    clean = normalized(value_count_table(df, text), ["value"], lower=False, compose=compose)
    found = text_stats(clean, kind_stats(F.col("n")))
    return out.unionByName(found.select("column", kind_rule(text, bool_ratio, date_ratio, number_ratio, hinted_date_ratio).alias("kind")))


def fixed_kinds(df: DataFrame) -> tuple[list[tuple[str, str]], list[str]]:
    """Kinds that follow from the column type, and the columns whose text must be read."""
    fixed, text = [], []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            fixed.append((f.name, "boolean"))
        elif is_numeric(f.dataType):
            fixed.append((f.name, "numeric"))
        elif is_time(f.dataType):
            fixed.append((f.name, "datetime"))
        else:
            text.append(f.name)
    return fixed, text


def kind_stats(weight: Column) -> dict[str, Column]:
    """Weighted counts of cleaned ``value`` text that is present and reads as flag, number, date."""
    v = F.col("value")
    count = lambda e: F.coalesce(F.sum(F.when(e.isNotNull(), weight)), F.lit(0)).cast("bigint")
    return {
        "filled": count(v), "flags": count(parse_bool(v, cleaned=True)),
        "numbers": count(parse_number(v, cleaned=True)), "dates": count(parse_date(v)),
    }


def kind_rule(columns: Sequence[str], bool_ratio: float, date_ratio: float, number_ratio: float, hinted_date_ratio: float) -> Column:
    """Kind from the counts ``filled``, ``flags``, ``numbers`` and ``dates``; flags first, then dates."""
    hinted = [c for c in columns if set(name_tokens(c)) & set(DATE_WORDS)]
    filled = F.greatest(F.col("filled"), F.lit(1))
    needed = F.when(F.col("column").isin(hinted), F.lit(min(hinted_date_ratio, date_ratio))).otherwise(F.lit(date_ratio))
    return (
        F.when(F.col("filled") == 0, "categorical")
        .when(F.col("flags") / filled >= bool_ratio, "boolean")
        .when(F.col("dates") / filled >= needed, "datetime")
        .when(F.col("numbers") / filled >= number_ratio, "numeric")
        .otherwise("categorical")
    )


def apply_casts(df: DataFrame, plan: dict[str, str], min_ratio: float = 0.7) -> DataFrame:
    """Cast columns as planned; a number cast is left out where too few of all rows read as one."""
    plan = {c: t for c, t in plan.items() if c in df.columns}
    kinds = {"int": "integer"}
    plan = {c: kinds.get(t, t) for c, t in plan.items()}

    def number(c: str) -> Column:
        return finite(col(c)) if is_numeric(df.schema[c].dataType) else parse_number_loose(col(c))

    wanted = [c for c, t in plan.items() if t in ("integer", "float")]
    good = set()
    if wanted:
        row = df.agg(*[F.avg(number(c).isNotNull().cast("int")).alias(f"r{i}") for i, c in enumerate(wanted)]).first()
        good = {c for i, c in enumerate(wanted) if (row[i] or 0.0) >= min_ratio}
    out = []
    for c in df.columns:
        kind = plan.get(c)
        timed = is_time(df.schema[c].dataType)
        if kind == "date":
            e = col(c).cast("timestamp") if timed else parse_date(clean_text(col(c)), dayfirst=True)
        elif kind == "time":
            e = time_of_day(col(c) if timed else parse_date(clean_text(col(c))))
        elif kind == "integer" and c in good:
            e = to_int(number(c))
        elif kind == "float" and c in good:
            e = number(c)
        elif kind == "boolean" and isinstance(df.schema[c].dataType, T.StringType):
            e = parse_bool(col(c)) == 1.0
        else:
            e = col(c)
        out.append(e.alias(c))
    return df.select(*out)


def task_of_statement(statement: str) -> str:
    text = (statement or "").lower()
    return "classification" if any(h in text for h in CLASSIFICATION_HINTS) else "regression"


def _target_facts(df: DataFrame, target: str) -> tuple[float, int, int]:
    """Share of values that read as a number, distinct values and rows."""
    c = col(target)
    parsed = finite(c) if is_numeric(df.schema[target].dataType) else F.when(F.lower(F.trim(c.cast("string"))).rlike(NUMBER), F.lit(1.0))
    row = df.agg(F.count(parsed).alias("p"), F.count("*").alias("n"), F.count_distinct(c).alias("d")).first()
    return (row["p"] / row["n"] if row["n"] else 0.0), row["d"], row["n"]


#: What the data must show to overrule the task that a statement asks for: (numeric share, distinct values) -> bool.
OVERRULED = {
    "regression": ("classification", lambda numeric, distinct: numeric < 0.5 and distinct <= 20),
    "classification": ("regression", lambda numeric, distinct: numeric >= 0.8 and distinct > 25),
}


def target_evidence(columns: Sequence[str], statement: str) -> list[tuple[int, int, str, str]]:
    """Rows (rule, place, name, column), the smallest of which is the target; each rule that holds for a column gives a row.

    0: the statement has the column's name (place: of the column); 1: the statement has a target word of that name (place: in the
    statement); 2: the name has a target word; 3: it is a column.
    """
    text = (statement or "").lower()
    rows = []
    for place, c in enumerate(columns):
        words = set(TARGET_PRIORITY) & set(name_tokens(c))
        rows.append((3, 0, c.lower(), c))
        rows += [(2, 0, c.lower(), c)] if words else []
        rows += [(1, text.index(w), c.lower(), c) for w in words if w in text]
        rows += [(0, place, c.lower(), c)] if c.lower() in text else []
    return rows


def choose_target(df: DataFrame, statement: str) -> dict[str, str]:
    """The column with the best evidence, and the statement's task unless the data overrule it."""
    evidence = target_evidence(df.columns, statement)
    if not evidence:
        raise ValueError("no columns to choose a target from")
    target = min(evidence)[3]
    numeric, distinct, _ = _target_facts(df, target)
    task = task_of_statement(statement)
    other, holds = OVERRULED[task]
    return validate_target(df, {"target": target, "task": other if holds(numeric, distinct) else task})


def validate_target(df: DataFrame, choice: dict[str, str]) -> dict[str, str]:
    if choice.get("target") not in df.columns:
        raise ValueError(f"target {choice.get('target')!r} is not a column")
    if str(choice.get("task", "")).lower() not in TASKS:
        raise ValueError(f"unknown task {choice.get('task')!r}")
    return {"target": choice["target"], "task": str(choice["task"]).lower()}


def fallback_target(df: DataFrame) -> dict[str, str]:
    """The last column; regression when it is numeric and varied."""
    target = df.columns[-1]
    ratio, distinct, rows = _target_facts(df, target)
    task = "regression" if ratio >= 0.9 and distinct / max(1, rows) > 0.05 else "classification"
    return {"target": target, "task": task}


def distinct_table(df: DataFrame) -> DataFrame:
    """Distinct values per column without and with the null value."""
    a = distinct_counts(df, dropna=True).withColumnRenamed("n_distinct", "n_values")
    b = distinct_counts(df, dropna=False).withColumnRenamed("n_distinct", "n_with_null")
    return a.join(b, "column")
