"""Duplicates hidden by formatting: Merkle-style digests of nested records.

A record is a tree. Leaves are normalised (only letters and digits count, in
lower case), children of an unordered node are sorted by their digests, and
each node's digest covers those of its children, up to the root. Records are
grouped by root digest, of which sixteen bytes are all that is shuffled. Only
records whose root occurs again are looked at once more: the canonical forms of
their whole trees are compared, so that a class holds only records of equal
structure even if two digests should collide.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnspark.session import cut_lineage

#: One to three words, the name of a field.
LABEL = r"\p{L}[\p{L}\p{N}]*(?:[ _-][\p{L}\p{N}]+){0,2}"
#: What stands between two fields, and between a field's name and its value.
FIELD_BREAK = r"(?:\||;|//|\n|\r)[\s\x{a0}]*"
FIELD_MARK = r"[\s\x{a0}]*(?:[:=]|[\s\x{a0}][\-\x{2013}\x{2014}]+[\s\x{a0}])"
_CUT = "\x01"
#: A class of more copies than this is joined in salted parts, as long as there are no more than HOT_CLASSES of them; beyond, those of more than a HOT_CLASSES-th of all copies are, so that what a task gets stays a small share of any table.
HOT_ROWS = 50_000
HOT_CLASSES = 100_000
#: Most 64-bit words of the filter that keeps records without a copy out of the second look; a fuller one lets more pass, but loses none.
FILTER_WORDS = 1 << 20


def leaf(c: Column) -> Column:
    """Letters and digits in lower case; null stays null."""
    return F.regexp_replace(F.lower(c.cast("string")), r"[^\p{L}\p{N}]+", "")


def _let(c: Column, use) -> Column:
    """``use`` of a column that is worked out once per row, however often it occurs in there."""
    return F.element_at(F.transform(F.array(c), use), 1)


def labelled_fields(text: Column) -> Column:
    """``label: value`` fields of a text as an array of structs; null where the text isn't written as two or more fields."""
    name = rf"(?s)^[\s\x{{a0}}]*({LABEL}){FIELD_MARK}(.*)$"
    marked = F.regexp_replace(text, FIELD_BREAK + f"({LABEL}{FIELD_MARK})", _CUT + "$1")
    field = lambda p: F.struct(F.regexp_extract(p, name, 1).alias("label"), F.regexp_extract(p, name, 2).alias("value"))
    read = _let(marked, lambda m: F.when((F.instr(m, _CUT) > 0) & m.rlike(name), F.transform(F.split(m, _CUT), field)))
    return F.when(text.rlike(r"[|;\n\r]|//"), read)


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def node(c: Column, kind: T.DataType, unordered: bool = True) -> tuple[Column, Column]:
    """(digest, canonical form) of a column of any nested type.

    Struct fields and map entries carry no order; array elements do unless
    ``unordered``. Canonical forms are unambiguous because a normalised leaf
    holds none of the marks used between nodes. A null child is ``~``.
    """
    if isinstance(kind, T.StructType):
        kids = sorted(((f.name, *node(c[f.name], f.dataType, unordered)) for f in kind.fields), key=lambda k: k[0].lower())
        forms = [F.concat(F.lit(f"{n.lower()}="), F.coalesce(form, F.lit("~"))) for n, _, form in kids]
        digests = [F.concat(F.lit(f"{n.lower()}="), F.coalesce(d, F.lit("~"))) for n, d, _ in kids]
        return F.when(c.isNotNull(), _md5(F.concat_ws(",", *digests))), F.when(c.isNotNull(), F.concat(F.lit("("), F.concat_ws(",", *forms), F.lit(")")))
    if isinstance(kind, T.MapType):
        entry = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        return node(F.map_entries(c), entry, True)
    if isinstance(kind, T.ArrayType):
        digests = F.transform(c, lambda x: F.coalesce(node(x, kind.elementType, unordered)[0], F.lit("~")))
        forms = F.transform(c, lambda x: F.coalesce(node(x, kind.elementType, unordered)[1], F.lit("~")))
        if unordered:
            digests, forms = F.array_sort(digests), F.array_sort(forms)
        return F.when(c.isNotNull(), _md5(F.concat(F.lit("["), F.array_join(digests, ","), F.lit("]")))), F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(forms, ","), F.lit("]")))
    form = leaf(c)
    return _md5(form), form


def text_node(c: Column) -> Column:
    """struct(digest, form) of a text: an unordered node where it is written as labelled fields, else a leaf."""
    pair = lambda f: F.concat(leaf(f["label"]), F.lit("="), leaf(f["value"]))
    bag = lambda kids: F.concat(F.lit("["), F.array_join(F.array_sort(kids), ","), F.lit("]"))
    of_fields = lambda ps: F.struct(_md5(bag(F.transform(ps, _md5))).alias("digest"), bag(ps).alias("form"))
    of_leaf = lambda x: F.struct(_md5(x).alias("digest"), x.alias("form"))
    return _let(
        F.transform(labelled_fields(c), pair),
        lambda ps: F.when(ps.isNotNull(), of_fields(ps)).otherwise(_let(leaf(c), of_leaf)),
    )


def keyed(df: DataFrame, id_col: str, columns: Mapping[str, str]) -> DataFrame:
    """(id, root, form) of each record that counts.

    ``columns`` maps a column to ``text`` (labelled fields are unordered),
    ``leaf``, ``tree`` (nested, arrays ordered) or ``bag`` (nested, arrays
    unordered). A record with a null column, or with one in which no letter or
    digit is left, has no key and is left out.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    nodes, useful = [], F.lit(True)
    for name, how in columns.items():
        c = df[name]
        if how == "text":
            n = text_node(c)
        else:
            digest, form = node(c, T.StringType() if how == "leaf" else kinds[name], how == "bag")
            n = F.struct(digest.alias("digest"), form.alias("form"))
        nodes.append(n)
        seen = c if isinstance(kinds[name], T.StringType) else F.to_json(c) if isinstance(kinds[name], (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")
        useful = useful & F.coalesce(seen.rlike(r"[\p{L}\p{N}]"), F.lit(False))
    ids = [n + 1 for n in range(len(nodes))]
    rows = df.where(useful).select(df[id_col].alias("id"), *[n.alias(f"n{i}") for i, n in zip(ids, nodes, strict=True)])
    # Both can't be null here; saying so keeps joins from testing them, which would work them out twice.
    return rows.select(
        "id",
        F.coalesce(F.unhex(_md5(F.concat_ws("\x02", *[F.col(f"n{i}.digest") for i in ids]))), F.lit(b"")).alias("root"),
        F.concat_ws("\x02", *[F.col(f"n{i}.form") for i in ids]).alias("form"),
    )


def roots(rows: DataFrame) -> DataFrame:
    """(root, first_id, n) of each root digest; summed up before the shuffle."""
    return rows.groupBy("root").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def repeated(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """Those of ``rows`` whose root is in ``twice``, and a few more; no row is shuffled.

    The roots are kept as a bit table of at most FILTER_WORDS words, which is
    broadcast; bit and word are those of a hash of the root.
    """
    words = 1 << min(FILTER_WORDS.bit_length() - 1, max(10, (twice.count() // 8).bit_length()))
    h = F.xxhash64("root")
    word, bit = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1)), F.expr("shiftleft(1L, cast(xxhash64(root) & 63 as int))")
    bits = twice.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.join(F.broadcast(bits), word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).select("id", "root", "form")


def classes(rows: DataFrame) -> DataFrame:
    """(root, form, first_id, n_copies) of each class of equal records; groups are summed up before the shuffle."""
    return rows.groupBy("root", "form").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))


def collapse(df: DataFrame, id_col: str, columns: Mapping[str, str]) -> DataFrame:
    """One row per distinct record: (first_id, n_copies). Empty input gives no rows; repeated rows count as copies."""
    rows = keyed(df, id_col, columns)
    by_root = cut_lineage(roots(rows))
    twice = by_root.where("n > 1")
    # Roots that the filter let pass though they occur once are told apart here.
    several = classes(repeated(rows, twice)).join(twice.select("root"), "root", "left_semi")
    return by_root.where("n = 1").select("first_id", F.col("n").alias("n_copies")).unionByName(several.select("first_id", "n_copies"))


def members(df: DataFrame, id_col: str, columns: Mapping[str, str]) -> DataFrame:
    """(id, first_id, n_copies) of each record that has copies.

    Records whose root occurs again are written to the shared folder; they find
    their class by root digest and canonical form. Classes that hold more than
    HOT_ROWS rows, of which at most HOT_CLASSES count, are known on every task,
    and their rows and class are salted, so that a class holding a third of the
    table is split.
    """
    rows = keyed(df, id_col, columns)
    again = cut_lineage(repeated(rows, cut_lineage(roots(rows).where("n > 1").select("root"))))
    several = cut_lineage(classes(again).where("n_copies > 1"))
    total = several.agg(F.coalesce(F.sum("n_copies"), F.lit(0)).alias("n")).scalar()
    hot = several.where(F.col("n_copies") > F.greatest(F.lit(HOT_ROWS).cast("double"), total / HOT_CLASSES))
    hot = hot.select(F.col("root").alias("hot_root"), F.ceil(F.col("n_copies") / HOT_ROWS).cast("int").alias("parts")).groupBy("hot_root").agg(F.max("parts").alias("parts"))
    with_hot = lambda d: d.join(F.broadcast(hot), d["root"] == F.col("hot_root"), "left").drop("hot_root")
    left = with_hot(again).withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(0).cast("int")).drop("parts")
    right = with_hot(several).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, ["root", "form", "salt"]).select("id", "first_id", "n_copies")


def copies(df: DataFrame, id_col: str, columns: Mapping[str, str]) -> DataFrame:
    """(first_id, copy_id) for each copy of an earlier record. Rows that repeat the first id are no copies of themselves."""
    m = members(df, id_col, columns)
    return m.where(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("copy_id"))
