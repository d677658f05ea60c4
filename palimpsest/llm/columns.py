"""Column names that an operator may add to a table of unknown columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def own_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before them until ``df`` has none of them, whatever the case."""
    taken = {c.lower() for c in df.columns}
    lead = "_"
    while any((lead + x).lower() in taken for x in names):
        lead += "_"
    return [lead + x for x in names]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row, also where lambdas inside ``body`` use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, state: Column, step, made: str, block: int = 64) -> Column:
    """Walk an array with a state and collect what each step gives; its cost grows with the array's length, not its square.

    ``step(state, item)`` gives (new state, array of what the item makes, of the type ``made``). Arrays
    grow by copying, so the walk fills one of ``block`` items after another and these are joined at the end.
    """

    def inside(s: Column, part: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            after, out = step(acc["state"], x)
            return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

        return F.aggregate(part, F.struct(s.alias("state"), F.array().cast(made).alias("out")), one)

    def blocks(all_items: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / block).cast("int"))

        def each(acc: Column, k: Column) -> Column:
            part = F.slice(all_items, k * block + 1, F.lit(block))
            return let(inside(acc["state"], part), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        start = F.struct(state.alias("state"), F.array().cast(f"array<{made}>").alias("out"))
        return F.flatten(F.aggregate(cuts, start, each)["out"])

    return F.when(F.size(items) > 0, let(items, blocks)).otherwise(F.array().cast(made))


def cut(text: Column, spans: Column, widths: tuple[int, ...] = (4096, 64)) -> Column:
    """The pieces of ``text`` at sorted ``spans`` (start, end) that don't overlap, as an array.

    A cut counts code points from the beginning of what it cuts; runs of spans are first cut off
    together, wide ones and then narrow ones, so that the cost stays near the text's length.
    """

    def level(t: Column, base: Column, own: Column, left: tuple[int, ...]) -> Column:
        if not left:
            return F.transform(own, lambda s: F.substr(t, s["start"] - base + 1, s["end"] - s["start"]))

        def run(k: Column) -> Column:
            def stretch(part: Column) -> Column:
                first = F.get(part, F.lit(0))["start"]
                inside = F.substr(t, first - base + 1, F.element_at(part, -1)["end"] - first)
                return let(F.struct(inside.alias("t"), first.alias("b")), lambda x: level(x["t"], x["b"], part, left[1:]))

            return let(F.slice(own, k * left[0] + 1, F.lit(left[0])), stretch)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / left[0]).cast("int")), run))

    return F.when(F.size(spans) > 0, let(spans, lambda own: level(text, F.lit(0), own, widths))).otherwise(F.array().cast("array<string>"))
