"""Data rules of the ledger tables as violation counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duesflow.schemas import TABLES

INVOICE_FORMAT = "^[0-9]{10}$"
SMALL_DIGITS = 8


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count; NULL keys do not count."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return (
        df.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("veces")).where("veces > 1")
    )


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference points to no parent row."""
    parents = parent.select(F.col(parent_column).alias(column))
    return df.where(F.col(column).isNotNull()).join(parents, column, "left_anti")


def valid_invoice(number: Column) -> Column:
    return number.rlike(INVOICE_FORMAT) & (number.try_cast("bigint") > 0)


def row_rules(table: str) -> dict[tuple[str, str], Column]:
    """Violation predicates of one row: (rule, column) to condition."""
    spec = TABLES[table]
    rules = {("required", c): F.col(c).isNull() for c in spec.required}
    rules |= {("width", c): F.length(c) > n for c, n in spec.widths.items()}
    rules |= {("size", c): F.abs(F.col(c)) >= 10**SMALL_DIGITS for c in spec.small}
    if table == "GastoOrdinario":
        rules[("format", "nroFactura")] = ~valid_invoice(F.col("nroFactura"))
    return rules


def _key(columns: Sequence[str]) -> tuple[Column, Column]:
    """(known, text): whether no key column is NULL, and the key as one text that tells different keys apart."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    texts = [F.col(c).cast("string") for c in columns]
    if len(texts) == 1:
        return known, texts[0]
    return known, F.concat_ws(":", *[part for t in texts for part in (F.length(t).cast("string"), t)])


def quality_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(tabla, regla, columnas, violaciones) for every rule of the given tables.

    ``unique`` counts repeated key values, ``reference`` counts orphan rows; references
    to tables that are not given are skipped. A rule without violations has a row with 0.

    Each table is read once: a row gives one entry per key that it holds as a unique key,
    as a reference or as the parent of a reference, and one with the set of its own rules
    that it breaks, as bits. All entries of all tables meet in one aggregation by rule and
    key, in which a hot key (a parent that many rows name, a set that many rows break)
    sends one row per task. References meet by the text form of the value.
    """
    kinds = ("own", "child", "parent", "bad")
    labels: list[tuple[str, str, str]] = []
    entries: dict[str, list[Column]] = {name: [] for name in tables}
    broken: list[Column] = []  # per table: the rules that a set of bits stands for

    def entry(table: str, rule: int, holds: Column, key: Column, kind: str) -> None:
        counts = [F.lit(int(k == kind)).cast("bigint").alias(k) for k in kinds]
        entries[table].append(F.when(holds, F.struct(F.lit(rule).alias("rule"), key.alias("key"), *counts)))

    for name in tables:
        spec = TABLES[name]
        first, rules = len(labels), row_rules(name)
        if rules:
            bits = reduce(lambda a, b: a + b, [F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
                                               for i, cond in enumerate(rules.values())])
            broken.append(F.array_compact(F.array(*[
                F.when(F.col("key").cast("bigint").bitwiseAND(F.lit(1 << i)) != 0, F.lit(first + i)) for i in range(len(rules))])))
            entry(name, -len(broken), bits != 0, bits.cast("string"), "bad")
            labels += [(name, rule, column) for rule, column in rules]
        for keys in spec.unique:
            entry(name, len(labels), *_key(keys), "own")
            labels.append((name, "unique", ",".join(keys)))
        for column, (parent, parent_column) in spec.references.items():
            if parent in tables:
                entry(name, len(labels), *_key([column]), "child")
                entry(parent, len(labels), *_key([parent_column]), "parent")
                labels.append((name, "reference", column))
    streams = [df.select(F.inline(F.array(*entries[name]))).where("rule IS NOT NULL") for name, df in tables.items()]
    met = reduce(DataFrame.unionByName, streams).groupBy("rule", "key").agg(*[F.sum(k).alias(k) for k in kinds])
    found = F.col("bad") + F.when(F.col("own") > 1, 1).otherwise(0) + F.when(F.col("parent") == 0, F.col("child")).otherwise(0)
    rules_of = F.array(F.col("rule"))
    for i, some in enumerate(broken):
        rules_of = F.when(F.col("rule") == -1 - i, some).otherwise(rules_of)
    violations = met.select("rule", "key", found.alias("n")).where("n > 0").select(F.explode(rules_of).alias("rule"), "n")
    # Every rule has an entry that counts nothing, so that it has a row.
    none = violations.sparkSession.range(len(labels)).select(F.col("id").cast("int").alias("rule"), F.lit(0).cast("bigint").alias("n"))
    label = F.get(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("tabla", "regla", "columnas"), row, strict=True)])
                            for row in labels]), F.col("rule"))
    return (violations.unionByName(none).groupBy("rule").agg(F.sum("n").alias("violaciones"))
            .select(label.alias("l"), "violaciones").select("l.*", "violaciones"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(Tabla, Registros) for each table."""
    return reduce(
        DataFrame.unionByName,
        [df.agg(F.count(F.lit(1)).alias("Registros")).select(F.lit(n).alias("Tabla"), "Registros")
         for n, df in tables.items()],
    )
