"""Header/column alias matching.

Matching order (reference semantics): an exact alias match over all fields
in map order; otherwise the first field, in map order, having an alias that
is a prefix of the normalised key; otherwise NULL. With ``longest_prefix``
the prefix step prefers the longest matching alias instead (so
"unit price (inr)" maps to unit_price rather than unit).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_key

# Header-field aliases, in the reference's order.
HEADER_FIELD_ALIASES = {
    "supplier_name": ["supplier", "vendor", "company", "supplier name", "from"],
    "quotation_ref": ["quotation ref", "quote ref", "quotation no", "quotation number"],
    "rfq_ref": ["rfq ref", "rfq no", "rfq number", "rfq"],
    "deadline_date": ["deadline", "due date", "last date", "closing date"],
    "currency": ["currency"],
    "delivery_terms": ["delivery terms"],
    "delivery_lead_time_days": ["lead time", "delivery time", "delivery lead time"],
    "payment_terms": ["payment terms"],
    "warranty": ["warranty", "guarantee"],
}

# Item-column aliases, in the reference's order.
ITEM_COLUMN_ALIASES = {
    "item_name": ["item name", "item", "description", "product", "material"],
    "quantity": ["quantity", "required quantity", "qty"],
    "unit": ["unit"],
    "unit_price": ["unit price", "price", "rate"],
    "total_price": ["total price", "total", "amount", "total cost"],
    "portion": ["portion", "portion spec"],
    "packaging": ["packaging", "packaging spec"],
}

HEADER_FIELDS = list(HEADER_FIELD_ALIASES)
ITEM_FIELDS = list(ITEM_COLUMN_ALIASES)


def match_normalized(nk: Column, alias_map: dict[str, list[str]],
                     longest_prefix: bool = False) -> Column:
    exact = [F.when(nk.isin(aliases), F.lit(field)) for field, aliases in alias_map.items()]
    if longest_prefix:
        pairs = sorted(((a, f) for f, al in alias_map.items() for a in al),
                       key=lambda p: -len(p[0]))
        prefix = [F.when(nk.startswith(a), F.lit(f)) for a, f in pairs]
    else:
        prefix = []
        for field, aliases in alias_map.items():
            cond = None
            for a in aliases:
                c = nk.startswith(a)
                cond = c if cond is None else (cond | c)
            prefix.append(F.when(cond, F.lit(field)))
    return F.coalesce(*exact, *prefix)


def match_alias(c, alias_map: dict[str, list[str]], longest_prefix: bool = False) -> Column:
    """Column of raw header text -> canonical field name (or NULL).

    For DataFrames prefer ``with_alias_field``: it computes the normalised
    key once as its own column, while this inline form repeats the key
    expression in every branch of the match."""
    return match_normalized(normalize_key(c), alias_map, longest_prefix)


def with_alias_field(df, src, out: str, alias_map: dict[str, list[str]],
                     longest_prefix: bool = False):
    """Adds ``out`` = field matched from the text column ``src``. The key is
    normalised once into a column, so the generated code of the match stays
    small and each row normalises its text a single time."""
    tmp = f"_nk_{out}"
    return (df.withColumn(tmp, normalize_key(src))
              .withColumn(out, match_normalized(F.col(tmp), alias_map, longest_prefix))
              .drop(tmp))


def match_alias_table(df: DataFrame, src: str, out: str, aliases: DataFrame, longest_prefix: bool = False) -> DataFrame:
    """``with_alias_field`` for an alias table of any size: ``aliases(alias, field, field_order)``,
    aliases normalised, ``field_order`` sorting like the map's order.

    Each distinct key is cut to every length that some alias has, and the cuts
    meet the aliases in one hash join; of those met the exact one wins, else
    the first field (with ``longest_prefix``: the longest alias). Both choices
    are a partial aggregate, and the keys join back to their rows, so neither
    a common key nor the alias table is held anywhere as a whole.
    """
    keyed = df.withColumn("_nk", normalize_key(src))
    table = aliases.filter(F.col("alias").isNotNull()).select("alias", "field", "field_order")
    lengths = sorted(r[0] for r in table.select(F.length("alias")).distinct().collect())  # one number for each length of an alias
    keys = keyed.filter(F.col("_nk").isNotNull()).select("_nk").distinct()
    cuts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_nk"))
    met = (keys.select("_nk", F.explode(cuts).alias("_n")).select("_nk", F.expr("substring(_nk, 1, _n)").alias("alias"))
           .join(table, "alias"))
    exact = F.col("alias") != F.col("_nk")  # false sorts first
    rule = [-F.length("alias"), F.col("field_order")] if longest_prefix else [F.col("field_order")]
    order = F.struct(exact, *[F.when(exact, r) for r in rule], F.col("field_order"))
    best = met.groupBy("_nk").agg(F.min_by("field", order).alias(out))
    return keyed.join(best, "_nk", "left").drop("_nk")


def sql_match(nk_sql: str, alias_map: dict[str, list[str]]) -> str:
    """The same rule as a SQL CASE over an already normalised key (used by
    the oracle statements)."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    exact = " ".join(f"WHEN {nk_sql} IN ({', '.join(q(a) for a in al)}) THEN {q(f)}"
                     for f, al in alias_map.items())
    pref = " ".join(
        f"WHEN {' OR '.join(f'starts_with({nk_sql}, {q(a)})' for a in al)} THEN {q(f)}"
        for f, al in alias_map.items())
    return f"(CASE {exact} {pref} END)"
