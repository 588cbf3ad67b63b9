"""Key/value structures as tables and set-based commands.

strings  kv(key, value, expire_at)         lists  lists(key, items array<string>)
sets     sets(key, member)                 zsets  zsets(key, member, score double)
hashes   hashes(key, fields map<string,string>)

Every command is a function from DataFrames to a DataFrame: reads give rows, writes give the new table. Empty containers
vanish. Score bounds may be exclusive; ranks count from 0 by (score, member).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# -- strings ----------------------------------------------------------------------------------------------------


def get(kv: DataFrame, key: str) -> DataFrame:
    return kv.where(F.col("key") == key).select("value")


def mget(kv: DataFrame, keys: list[str]) -> DataFrame:
    """Values in the order asked for, null where there is none."""
    asked = kv.sparkSession.createDataFrame(list(enumerate(keys)), "pos int, key string")
    return asked.join(kv.select("key", "value"), "key", "left").orderBy("pos").select("key", "value")


def _last(new: DataFrame, by: list[str], value: str) -> DataFrame:
    """Of rows with one key the last, in the order of the rows."""
    row = new.withColumn("kv_nth", F.monotonically_increasing_id())
    return row.groupBy(*by).agg(F.max(F.struct("kv_nth", value)).alias("kv_m")).select(*by, F.col(f"kv_m.{value}").alias(value))


def put(kv: DataFrame, new: DataFrame) -> DataFrame:
    """SET and MSET: upsert, clearing expiry. Of a key given twice the last value counts."""
    new = _last(new.select("key", "value"), ["key"], "value").withColumn("expire_at", F.lit(None).cast(dict(kv.dtypes)["expire_at"]))
    return kv.join(new.select("key"), "key", "left_anti").unionByName(new)


def put_new(kv: DataFrame, new: DataFrame, all_or_none: bool = False) -> DataFrame:
    """SETNX; with ``all_or_none`` MSETNX."""
    if all_or_none and not new.join(kv, "key", "left_semi").isEmpty():
        return kv
    return put(kv, new.join(kv, "key", "left_anti"))


def delete(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.where(~F.col("key").isin(keys))


def change(kv: DataFrame, key: str, value) -> DataFrame:
    """Sets ``value`` (a column over the old value) for one key; a missing key starts from null."""
    # An aggregate without keys gives one row, of nulls where the key is missing.
    one = kv.where(F.col("key") == key).agg(F.max("value").alias("value"), F.max("expire_at").alias("expire_at"))
    return kv.where(F.col("key") != key).unionByName(one.select(F.lit(key).alias("key"), value.cast("string").alias("value"), "expire_at"))


def incr(kv: DataFrame, key: str, by: int = 1) -> DataFrame:
    """INCR, DECR, INCRBY, DECRBY: fails on text and on 64-bit overflow."""
    old = F.coalesce("value", F.lit("0"))
    number = F.when(old.rlike(r"^-?\d{1,19}$"), old.cast("decimal(20,0)") + F.lit(by).cast("decimal(20,0)")).otherwise(F.raise_error(F.lit("not an integer")).cast("decimal(20,0)"))
    return change(kv, key, F.when(number.between(-(2**63), 2**63 - 1), number).otherwise(F.raise_error(F.lit("overflow")).cast("decimal(20,0)")))


def append(kv: DataFrame, key: str, text: str) -> DataFrame:
    return change(kv, key, F.concat(F.coalesce("value", F.lit("")), F.lit(text)))


def strlen(kv: DataFrame, key: str) -> DataFrame:
    return get(kv, key).agg(F.coalesce(F.max(F.octet_length("value")), F.lit(0)).alias("length"))


def getrange(kv: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Inclusive byte slice; negative places from the end. An end before the start of the text counts as the first byte."""
    b, n = F.col("value").cast("binary"), F.octet_length("value")
    lo = F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0))
    hi = F.least(F.greatest(F.lit(end) if end >= 0 else n + end, F.lit(0)), n - 1)
    return get(kv, key).select(F.when((lo <= hi) & (n > 0), F.substring(b, lo + 1, hi - lo + 1).cast("string")).otherwise("").alias("value"))


def _bytes(least: int) -> str:
    """SQL for the value's bytes, filled with zero bytes up to ``least``."""
    b = "cast(coalesce(value, '') as binary)"
    return f"rpad({b}, greatest(octet_length({b}), {least}), X'00')"


def setrange(kv: DataFrame, key: str, at: int, text: str) -> DataFrame:
    """Overwrites bytes from ``at``; a gap is filled with zero bytes."""
    new = F.lit(text.encode().hex())
    return change(kv, key, F.overlay(F.expr(_bytes(at)), F.unhex(new), F.lit(at + 1)).cast("string"))


def getbit(kv: DataFrame, key: str, at: int) -> DataFrame:
    """Bit 0 is the highest of the first byte; bits past the end are 0."""
    byte = F.conv(F.hex(F.substr(F.encode("value", "utf-8"), F.lit(at // 8 + 1), F.lit(1))), 16, 10).cast("int")
    return get(kv, key).select(F.coalesce(F.shiftright(byte, 7 - at % 8).bitwiseAND(1), F.lit(0)).alias("bit"))


def setbit(kv: DataFrame, key: str, at: int, bit: int) -> DataFrame:
    """Bit 0 is the highest of the first byte; the value grows by zero bytes."""
    b, mask = _bytes(at // 8 + 1), 1 << 7 - at % 8
    old = f"cast(conv(hex(substring({b}, {at // 8 + 1}, 1)), 16, 10) as int)"
    new = f"({old} | {mask})" if bit else f"({old} & {255 - mask})"
    return change(kv, key, F.expr(f"cast(overlay({b} placing unhex(lpad(hex({new}), 2, '0')) from {at // 8 + 1}) as string)"))


def rename(table: DataFrame, old: str, new: str, only_new: bool = False) -> DataFrame:
    """RENAME and, with ``only_new``, RENAMENX. A missing key and one name for both are errors."""
    if old == new:
        raise ValueError("source and destination are the same")
    if table.where(F.col("key") == old).isEmpty():
        raise ValueError("no such key")
    if only_new and not table.where(F.col("key") == new).isEmpty():
        return table
    return table.where(F.col("key") != new).withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key")))


def expire(kv: DataFrame, key: str, at) -> DataFrame:
    """EXPIREAT, EXPIRE (``at`` from now) and PERSIST (None). A past time removes the key at the next :func:`alive`."""
    at = F.lit(None) if at is None else at
    return kv.withColumn("expire_at", F.when(F.col("key") == key, at).otherwise(F.col("expire_at")))


def alive(kv: DataFrame, now=None) -> DataFrame:
    return kv.where(F.col("expire_at").isNull() | (F.col("expire_at") > (F.current_timestamp() if now is None else now)))


def ttl(kv: DataFrame, key: str, now=None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    left = F.col("expire_at").cast("timestamp").cast("long") - now.cast("timestamp").cast("long")
    return kv.where(F.col("key") == key).agg(F.coalesce(F.max(F.when(left > 0, left)), F.lit(-1)).alias("ttl"))


def keys(table: DataFrame, glob: str) -> DataFrame:
    return table.where(F.col("key").rlike(glob_regex(glob))).select("key").distinct()


def glob_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out += "\\" + glob[i]
        elif c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out += glob[i : end + 1]
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, c if c.isalnum() else "\\" + c)
        i += 1
    return f"(?s)^{out}$"


# -- lists ------------------------------------------------------------------------------------------------------


def _items(lists: DataFrame, key: str, items) -> DataFrame:
    """One list changed by a column over ``items``; it vanishes when empty."""
    return lists.select("key", F.when(F.col("key") == key, items).otherwise(F.col("items")).alias("items")).where(F.size("items") > 0)


def push(lists: DataFrame, key: str, values: list[str], left: bool = False, only_existing: bool = False) -> DataFrame:
    new = F.array(*[F.lit(v) for v in (reversed(values) if left else values)])
    out = _items(lists, key, F.concat(new, "items") if left else F.concat("items", new))
    if only_existing:
        return out
    missing = lists.sparkSession.createDataFrame([(key,)], "key string").join(lists, "key", "left_anti").select("key", new.alias("items"))
    return out.unionByName(missing)


def _slice(start: int, end: int):
    n = F.size("items")
    lo = F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0))
    hi = F.least(F.lit(end) if end >= 0 else n + end, n - 1)
    return F.when(lo <= hi, F.slice("items", lo + 1, hi - lo + 1)).otherwise(F.array().cast("array<string>"))


def lrange(lists: DataFrame, start: int, end: int) -> DataFrame:
    """Inclusive slice of every list given (filter by key for one)."""
    return lists.select("key", _slice(start, end).alias("items"))


def ltrim(lists: DataFrame, key: str, start: int, end: int) -> DataFrame:
    return _items(lists, key, _slice(start, end))


def lindex(lists: DataFrame, at: int) -> DataFrame:
    return lists.select("key", F.try_element_at("items", F.lit(at + 1 if at >= 0 else at)).alias("value"))


def llen(lists: DataFrame) -> DataFrame:
    return lists.select("key", F.size("items").alias("length"))


def pop(lists: DataFrame, key: str, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """(value, new table)."""
    one = lists.where(F.col("key") == key).select(F.element_at("items", 1 if left else -1).alias("value"))
    return one, _items(lists, key, _slice(1, -1) if left else _slice(0, -2))


def rpoplpush(lists: DataFrame, source: str, target: str) -> DataFrame:
    value = lists.where(F.col("key") == source).select(F.element_at("items", -1).alias("v"), F.lit(target).alias("key"))
    rest = pop(lists, source, left=False)[1]
    joined = rest.join(F.broadcast(value), "key", "full_outer")
    return joined.select("key", F.when(F.col("v").isNull(), F.col("items")).otherwise(F.concat(F.array("v"), F.coalesce("items", F.array().cast("array<string>")))).alias("items"))


def lset(lists: DataFrame, key: str, at: int, value: str) -> DataFrame:
    place = F.lit(at) if at >= 0 else F.size("items") + at
    changed = F.when((place >= 0) & (place < F.size("items")), F.transform("items", lambda x, i: F.when(i == place, F.lit(value)).otherwise(x))).otherwise(F.raise_error(F.lit("index out of range")).cast("array<string>"))
    return _items(lists, key, changed)


def linsert(lists: DataFrame, key: str, pivot: str, value: str, before: bool = True) -> DataFrame:
    """Beside the first pivot from the head; unchanged if there is none."""
    at = F.array_position("items", pivot).cast("int")
    new = F.when(at > 0, F.array_insert("items", F.when(at > 0, at + (0 if before else 1)).otherwise(1), F.lit(value))).otherwise(F.col("items"))
    return _items(lists, key, new)


def lrem(lists: DataFrame, key: str, value: str, count: int = 0) -> DataFrame:
    """Removes ``count`` occurrences from the head, from the tail if negative, all if 0."""
    if count == 0:
        return _items(lists, key, F.array_remove("items", value))
    items = F.col("items") if count > 0 else F.reverse("items")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))
    kept = F.aggregate(items, start, lambda t, x: F.when((x == value) & (t.n < abs(count)), F.struct(t.out.alias("out"), (t.n + 1).alias("n"))).otherwise(F.struct(F.array_append(t.out, x).alias("out"), t.n.alias("n"))), lambda t: t.out)
    return _items(lists, key, kept if count > 0 else F.reverse(kept))


# -- sets -------------------------------------------------------------------------------------------------------


def sadd(sets: DataFrame, new: DataFrame) -> DataFrame:
    return sets.unionByName(new.select("key", "member")).distinct()


def srem(sets: DataFrame, gone: DataFrame) -> DataFrame:
    return sets.join(gone, ["key", "member"], "left_anti")


def smove(sets: DataFrame, source: str, target: str, member: str) -> DataFrame:
    hit = (F.col("key") == source) & (F.col("member") == member)
    return sets.withColumn("key", F.when(hit, target).otherwise(F.col("key"))).distinct()


def scard(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.count("*").alias("card"))


def sunion(sets: DataFrame, names: list[str]) -> DataFrame:
    return sets.where(F.col("key").isin(names)).select("member").distinct()


def sinter(sets: DataFrame, names: list[str]) -> DataFrame:
    """Members of all sets named: one aggregate by member, whatever the number of sets. A missing set gives none."""
    n = len(set(names))
    return sets.where(F.col("key").isin(names)).groupBy("member").agg(F.count_distinct("key").alias("n")).where(F.col("n") == n).select("member")


def sdiff(sets: DataFrame, first: str, others: list[str]) -> DataFrame:
    by = sets.where(F.col("key").isin([first, *others])).groupBy("member").agg(F.bool_or(F.col("key") == first).alias("a"), F.bool_or(F.col("key").isin(others)).alias("b"))
    return by.where("a and not b").select("member")


def store(table: DataFrame, members: DataFrame, target: str) -> DataFrame:
    """The ..STORE form: ``members`` in place of whatever ``target`` held."""
    return table.where(F.col("key") != target).unionByName(members.select(F.lit(target).alias("key"), *[c for c in table.columns if c != "key"]))


def srandmember(sets: DataFrame, key: str, seed: int) -> DataFrame:
    return sets.where(F.col("key") == key).orderBy(F.xxhash64("member", F.lit(seed))).limit(1).select("member")


# -- sorted sets ------------------------------------------------------------------------------------------------


def zadd(z: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of scores; of a member given twice the last score counts."""
    new = _last(new.select("key", "member", "score"), ["key", "member"], "score")
    return z.join(new, ["key", "member"], "left_anti").unionByName(new)


def zincrby(z: DataFrame, new: DataFrame) -> DataFrame:
    return z.unionByName(new.select("key", "member", "score")).groupBy("key", "member").agg(F.sum("score").alias("score"))


def zalgebra(z: DataFrame, names: list[str], weights: list[float] | None = None, aggregate: str = "SUM", inter: bool = False) -> DataFrame:
    """ZUNIONSTORE and ZINTERSTORE: one aggregate by member. A name listed twice counts twice with its own weight."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for i, (k, w) in enumerate(zip(names, weights or [1.0] * len(names)))])
    tagged = z.where(F.col("key").isin(names)).withColumn("p", F.explode(F.filter(pairs, lambda p: p.k == F.col("key"))))
    # inf times 0 and inf plus -inf count as 0.
    s = F.col("score") * F.col("p.w")
    s = F.when(F.isnan(s), 0.0).otherwise(s)
    total = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}[aggregate.upper()](s)
    out = tagged.groupBy("member").agg(F.when(F.isnan(total), 0.0).otherwise(total).alias("score"), F.count_distinct("p.i").alias("n"))
    return (out.where(F.col("n") == len(names)) if inter else out).select("member", "score")


def zrank(z: DataFrame, descending: bool = False) -> DataFrame:
    """Rank of each member in its own set. For a rank over one huge set use ``orderBy`` with ``offset`` (:func:`zrange`)."""
    order = [F.desc("score"), F.desc("member")] if descending else [F.col("score"), F.col("member")]
    return z.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1)


def zrange(z: DataFrame, key: str, start: int, end: int, descending: bool = False) -> DataFrame:
    """Members by inclusive rank. A slice from the head is a top-k plan; negative places are resolved by one count."""
    one = z.where(F.col("key") == key)
    if start < 0 or end < 0:
        n = one.count()
        start, end = max(start + n if start < 0 else start, 0), end + n if end < 0 else end
    order = [F.desc("score"), F.desc("member")] if descending else ["score", "member"]
    return one.orderBy(*order).offset(start).limit(max(end - start + 1, 0)).select("member", "score")


def _in(low: str, high: str):
    out = F.lit(True)
    for bound, ops in ((low, ("__gt__", "__ge__")), (high, ("__lt__", "__le__"))):
        bound = str(bound)
        out = out & getattr(F.col("score"), ops[0 if bound.startswith("(") else 1])(float(bound.lstrip("(")))
    return out


def zrangebyscore(z: DataFrame, key: str, low: str, high: str, offset: int = 0, limit: int | None = None, descending: bool = False) -> DataFrame:
    order = [F.desc("score"), F.desc("member")] if descending else ["score", "member"]
    out = z.where((F.col("key") == key) & _in(low, high)).orderBy(*order)
    out = out.offset(offset) if offset else out
    return (out if limit is None else out.limit(limit)).select("member", "score")


def zcount(z: DataFrame, low: str, high: str) -> DataFrame:
    return z.where(_in(low, high)).groupBy("key").agg(F.count("*").alias("n"))


def zremrangebyscore(z: DataFrame, key: str, low: str, high: str) -> DataFrame:
    return z.where(~((F.col("key") == key) & _in(low, high)))


def zremrangebyrank(z: DataFrame, key: str, start: int, end: int) -> DataFrame:
    return z.join(zrange(z, key, start, end).select(F.lit(key).alias("key"), "member"), ["key", "member"], "left_anti")


# -- hashes -----------------------------------------------------------------------------------------------------


def hset(hashes: DataFrame, key: str, fields: dict[str, str], only_new: bool = False) -> DataFrame:
    new = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.lit(v))])
    old = F.map_filter("fields", lambda k, v: ~F.array_contains(F.map_keys(new), k))
    fresh = F.map_filter(new, lambda k, v: ~F.array_contains(F.map_keys("fields"), k))
    changed = F.map_concat("fields", fresh) if only_new else F.map_concat(old, new)
    missing = hashes.sparkSession.createDataFrame([(key,)], "key string").join(hashes, "key", "left_anti").select("key", new.alias("fields"))
    return hashes.select("key", F.when(F.col("key") == key, changed).otherwise(F.col("fields")).alias("fields")).unionByName(missing)


def hget(hashes: DataFrame, field: str) -> DataFrame:
    return hashes.select("key", F.try_element_at("fields", F.lit(field)).alias("value"))


def hmget(hashes: DataFrame, fields: list[str]) -> DataFrame:
    return hashes.select("key", F.array(*[F.try_element_at("fields", F.lit(f)) for f in fields]).alias("values"))


def hincrby(hashes: DataFrame, key: str, field: str, by: int) -> DataFrame:
    """Adds to a field; a missing field or key starts from 0. No overflow check: 64 bits wrap."""
    one = hashes.where(F.col("key") == key).agg(F.first("fields").alias("fields"))
    fields = F.coalesce("fields", F.create_map().cast("map<string,string>"))
    old = F.coalesce(F.try_element_at(fields, F.lit(field)), F.lit("0"))
    number = F.when(old.rlike(r"^-?\d{1,19}$"), old.cast("decimal(38,0)") + F.lit(by).cast("decimal(38,0)")).otherwise(F.raise_error(F.lit("not an integer")).cast("decimal(38,0)"))
    span = F.lit(str(2**63)).cast("decimal(38,0)")
    wrapped = (F.pmod(number + span, span * 2) - span).cast("string")
    changed = F.map_concat(F.map_filter(fields, lambda k, v: k != field), F.create_map(F.lit(field), wrapped))
    return hashes.where(F.col("key") != key).unionByName(one.select(F.lit(key).alias("key"), changed.alias("fields")))


def hdel(hashes: DataFrame, key: str, field: str) -> DataFrame:
    kept = F.map_filter("fields", lambda k, v: k != field)
    return hashes.select("key", F.when(F.col("key") == key, kept).otherwise(F.col("fields")).alias("fields")).where(F.size("fields") > 0)


def hgetall(hashes: DataFrame) -> DataFrame:
    return hashes.select("key", F.explode("fields").alias("field", "value"))


def hkeys(hashes: DataFrame) -> DataFrame:
    return hashes.select("key", F.map_keys("fields").alias("names"), F.map_values("fields").alias("values"), F.size("fields").alias("length"))


# -- sort -------------------------------------------------------------------------------------------------------


def sort(items: DataFrame, kv: DataFrame, by: str | None = None, get_patterns: list[str] | None = None, alpha: bool = False, descending: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """SORT of ``items`` (pos, value) by external keys. A pattern without ``*`` keeps the order; a missing weight is 0."""
    out = items.withColumn("weight", F.col("value"))
    if by and "*" in by:
        w = kv.select(F.col("key").alias("sort_key"), F.col("value").alias("sort_weight"))
        out = items.withColumn("sort_key", F.replace(F.lit(by), F.lit("*"), F.col("value"))).join(w, "sort_key", "left").withColumn("weight", F.coalesce("sort_weight", F.lit("" if alpha else "0")))
    weight = F.col("weight") if alpha else F.col("weight").cast("double")
    order = [F.col("pos")] if by and "*" not in by else [weight.desc() if descending else weight.asc(), F.col("value")]
    for i, pattern in enumerate(get_patterns or []):
        if pattern == "#":
            out = out.withColumn(f"get_{i}", F.col("value"))
            continue
        g = kv.select(F.col("key").alias(f"key_{i}"), F.col("value").alias(f"get_{i}"))
        out = out.withColumn(f"key_{i}", F.replace(F.lit(pattern), F.lit("*"), F.col("value"))).join(g, f"key_{i}", "left")
    out = out.orderBy(*order)
    out = out.offset(offset) if offset else out
    out = out if limit is None else out.limit(limit)
    return out.select("value", *[f"get_{i}" for i in range(len(get_patterns or []))])


# -- exchange with tables ---------------------------------------------------------------------------------------


def from_rows(df: DataFrame, key, member, kind: str) -> DataFrame:
    """Rows of a query as lists, sets or hashes (``member`` then gives field and value)."""
    if kind == "list":
        return df.groupBy(key.alias("key")).agg(F.collect_list(member).alias("items"))
    if kind == "set":
        return df.select(key.alias("key"), member.alias("member")).distinct()
    return df.groupBy(key.alias("key")).agg(F.map_from_entries(F.collect_list(member)).alias("fields"))


def to_rows(table: DataFrame) -> DataFrame:
    """A structure as a table: of lists (key, pk, value), of hashes (key, pk, field, value), pk counting from 0; of sets and
    sorted sets one row a member, numbered by member or by (score, member)."""
    if "items" in table.columns:
        return table.select("key", F.posexplode("items").alias("pk", "value"))
    if "fields" in table.columns:
        return table.select("key", F.posexplode(F.array_sort(F.map_entries("fields"))).alias("pk", "e")).select("key", "pk", F.col("e.key").alias("field"), F.col("e.value").alias("value"))
    order = ["score", "member"] if "score" in table.columns else ["member"]
    pk = F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1
    return table.select("key", pk.alias("pk"), F.col("member").alias("value"), *order[:-1])


def from_reply(spark, reply: list) -> DataFrame:
    """The reply of a command as a table (pk, value), in its order."""
    return spark.createDataFrame([(i, None if x is None else str(x)) for i, x in enumerate(reply)], "pk long, value string")
