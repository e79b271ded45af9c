"""Registered queries over versioned datasets, with their SQL.

Base, ours and theirs are three versions of ``orders`` by rules on the key;
commits are the orders of two neighbouring customers each, in order of time;
pack entries are the lines of ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import codec, grammar, hashing
from palimpsest.operators import diff as d
from palimpsest.operators import history, merge, objects, segment, store
from palimpsest.plans.snapshots import Schema, Snapshots
from palimpsest.plans.storage import shared_dir, stored
from palimpsest.sources.tables import table

VALUES = ["m", "s", "c"]
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Versions of orders: k key, m model, s status, c total in cents.


def source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.lit(7).alias("m"), F.col("o_orderstatus").alias("s"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c")
    )


def base(spark: SparkSession, sf: str) -> DataFrame:
    return source(spark, sf).where("k % 19 <> 0")


def ours(spark: SparkSession, sf: str) -> DataFrame:
    kept = base(spark, sf).where("k % 17 <> 0").selectExpr("k", "case when k % 65 = 0 then 8 else m end m", "case when k % 5 = 0 then 'X' else s end s", "c")
    return kept.unionByName(source(spark, sf).where("k % 19 = 0 and k % 2 = 0"))


def theirs(spark: SparkSession, sf: str) -> DataFrame:
    kept = base(spark, sf).where("k % 23 <> 0").selectExpr(
        "k", "m", "case when k % 35 = 0 and k % 3 = 0 then 'X' when k % 7 = 0 then 'Y' else s end s", "case when k % 11 = 0 then c + 1 else c end c"
    )
    return kept.unionByName(source(spark, sf).where("k % 19 = 0 and k % 3 = 0").selectExpr("k", "m", "case when k % 4 = 0 then 'Z' else s end s", "c"))


VERSIONS = """
source as (select o_orderkey k, 7 m, o_orderstatus s, cast(round(o_totalprice * 100) as bigint) c from orders),
base as (select * from source where k % 19 <> 0),
ours as (select k, case when k % 65 = 0 then 8 else m end m, case when k % 5 = 0 then 'X' else s end s, c from base where k % 17 <> 0
  union all select * from source where k % 19 = 0 and k % 2 = 0),
theirs as (select k, m, case when k % 35 = 0 and k % 3 = 0 then 'X' when k % 7 = 0 then 'Y' else s end s, case when k % 11 = 0 then c + 1 else c end c
  from base where k % 23 <> 0
  union all select k, m, case when k % 4 = 0 then 'Z' else s end s, c from source where k % 19 = 0 and k % 3 = 0)"""
DIFF = """
  select case when a.k is null then 1 when b.k is null then 2 else 3 end kind, coalesce(a.k, b.k) "key",
    a.m from_m, b.m to_m, a.s from_s, b.s to_s, a.c from_c, b.c to_c
  from base a full join {side} b on a.k = b.k
  where a.k is null or b.k is null or a.m <> b.m or a.s <> b.s or a.c <> b.c"""
CHANGED = f"""{VERSIONS},
od as ({DIFF.format(side="ours")}), td as ({DIFF.format(side="theirs")}),
z as (select coalesce(o."key", t."key") "key", o.kind o_kind, t.kind t_kind, coalesce(o.from_m, t.from_m) b_m, coalesce(o.from_s, t.from_s) b_s, coalesce(o.from_c, t.from_c) b_c,
  o.to_m o_m, o.to_s o_s, o.to_c o_c, t.to_m t_m, t.to_s t_s, t.to_c t_c from od o full join td t on o."key" = t."key"),
z2 as (select *, o_m is not distinct from t_m and o_s is not distinct from t_s and o_c is not distinct from t_c and o_kind = t_kind alike from z)"""


def classes_sql(alike: str, disagrees: str) -> str:
    return f"""with {CHANGED},
zc as (select *, case when t_kind is null then 'ours' when o_kind is null then case t_kind when 1 then 'theirs_added' when 2 then 'theirs_removed' else 'theirs_modified' end
  when o_kind = 2 and t_kind = 2 then 'both_deleted' when {alike} then 'convergent' when o_kind = 2 or t_kind = 2 then 'delete_edit' when o_kind = 1 then 'add_add'
  when o_m <> t_m or o_m <> b_m then 'model_change' when {disagrees} then 'both_changed' else 'combined' end "class" from z2)"""


CELLS = "(o_s <> b_s and t_s <> b_s and o_s <> t_s) or (o_c <> b_c and t_c <> b_c and o_c <> t_c)"
PER_CELL_SQL = classes_sql("alike", CELLS)
OPAQUE_SQL = classes_sql("alike", "o_s <> t_s or o_c <> t_c")
COUNTER = merge.Strategy(cells=True, accumulates=("c",))
COUNTER_SQL = classes_sql("alike and o_kind <> 3", "o_s <> b_s and t_s <> b_s and o_s <> t_s")


def merged_sql(classes: str, cents: str) -> str:
    return f"""{classes}
select k, m, s, c from ours where k not in (select "key" from zc where "class" like 'theirs_%' or "class" = 'combined')
union all select "key", t_m, t_s, t_c from zc where "class" in ('theirs_added', 'theirs_modified')
union all select "key", case when o_m = b_m then t_m else o_m end, case when o_s = b_s then t_s else o_s end, {cents} from zc where "class" = 'combined'"""


def changed(spark: SparkSession, sf: str, strategy: merge.Strategy) -> DataFrame:
    z = merge.zipped(base(spark, sf), ours(spark, sf), theirs(spark, sf), "k", VALUES)
    return merge.classified(z, VALUES, "m", strategy)


@query(f"with {VERSIONS} {DIFF.format(side='ours')}")
def d01_diff(spark, sf):
    return d.diff(base(spark, sf), ours(spark, sf), "k", VALUES)


@query(f"with {VERSIONS}, x as ({DIFF.format(side='theirs')}) select kind, \"key\" from x")
def d01_diff_by_hash(spark, sf):
    return d.diff_by_hash(base(spark, sf), theirs(spark, sf), "k", VALUES)


@query(f"with {VERSIONS}, late as (select k, m, s, c + case when k // 256 % 8 = 3 then 1 else 0 end c from base) {DIFF.format(side='late')}")
def d02_pruned_diff(spark, sf):
    late = base(spark, sf).withColumn("c", F.col("c") + F.when(F.expr("k div 256 % 8 = 3"), 1).otherwise(0))  # every eighth segment
    return d.pruned_diff(base(spark, sf), late, "k", VALUES, 256)


@query(f"with {VERSIONS}, late as (select k, m, s, c + case when k // 1024 % 8 = 1 then 1 else 0 end c from base) {DIFF.format(side='late')}")
def w02_incremental_snapshot(spark, sf):
    """A stored snapshot, edits that rewrite every eighth of its segments, and the diff that reads these alone."""
    rows = base(spark, sf)
    snapshots = Snapshots(spark, shared_dir(spark, "snapshots"), Schema("k", tuple(VALUES), "m", width=1024))
    edits = rows.where("k div 1024 % 8 = 1").select(F.lit("put").alias("op"), "k", "m", "s", (F.col("c") + 1).alias("c"))
    first = snapshots.write(rows)
    return snapshots.diff(first, snapshots.apply(first, edits, rows.schema), rows.schema)


@query(
    f"with {VERSIONS}, x as ({DIFF.format(side='theirs')}) select \"key\", 'm' \"column\", cast(from_m as varchar) before, cast(to_m as varchar) \"after\" from x where kind = 3 and from_m <> to_m"
    " union all select \"key\", 's', from_s, to_s from x where kind = 3 and from_s <> to_s union all select \"key\", 'c', cast(from_c as varchar), cast(to_c as varchar) from x where kind = 3 and from_c <> to_c"
)
def d04_detail_diff(spark, sf):
    return d.detail(d.diff(base(spark, sf), theirs(spark, sf), "k", VALUES), VALUES)


@query(f"with {VERSIONS}, x as ({DIFF.format(side='theirs')}) select kind, count(*) n from x group by kind")
def a03_diff_counts(spark, sf):
    return d.diff(base(spark, sf), theirs(spark, sf), "k", VALUES).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"with {VERSIONS} select * from theirs")
def w05_apply_changes(spark, sf):
    return d.apply_changes(base(spark, sf), d.diff(base(spark, sf), theirs(spark, sf), "k", VALUES), "k", VALUES)


@query(f'{PER_CELL_SQL} select "class", count(*) n from zc group by "class"')
def m02_merge_classes(spark, sf):
    return changed(spark, sf, merge.PER_CELL).groupBy("class").agg(F.count("*").alias("n"))


@query(f"{PER_CELL_SQL} select \"key\", \"class\" from zc where \"class\" in ('both_changed', 'delete_edit', 'add_add', 'model_change')")
def m02_conflicts(spark, sf):
    return changed(spark, sf, merge.PER_CELL).where(F.col("class").isin(*merge.CONFLICTS.values())).select("key", "class")


@query(merged_sql(PER_CELL_SQL, "case when o_c = b_c then t_c else o_c end"))
def m06_merge_per_cell(spark, sf):
    return merge.merge(base(spark, sf), ours(spark, sf), theirs(spark, sf), "k", VALUES, "m", merge.PER_CELL, max_conflicts=None)[0]


@query(merged_sql(OPAQUE_SQL, "o_c"))
def m05_merge_opaque(spark, sf):
    return merge.merge(base(spark, sf), ours(spark, sf), theirs(spark, sf), "k", VALUES, "m", merge.OPAQUE, max_conflicts=None)[0]


@query(merged_sql(COUNTER_SQL, "o_c + t_c - b_c"))
def m08_merge_counter(spark, sf):
    return merge.merge(base(spark, sf), ours(spark, sf), theirs(spark, sf), "k", VALUES, "m", COUNTER, max_conflicts=None)[0]


@query(
    f"""{PER_CELL_SQL} select count(*) filter ("class" = 'theirs_added') added, count(*) filter ("class" = 'theirs_removed') removed,
    count(*) filter ("class" in ('theirs_modified', 'combined')) modified, count(*) filter ("class" in ('both_changed', 'delete_edit', 'add_add', 'model_change')) conflicts from zc"""
)
def a03_merge_stats(spark, sf):
    return merge.stats(changed(spark, sf, merge.PER_CELL))


@query(
    """with e as (select distinct p_type x, p_size n, p_partkey k from part), b as (select distinct x from e where n % 2 = 0), o as (select distinct x from e where k % 3 = 0), t as (select distinct x from e where n % 5 <> 1)
    select x from b where x in (select x from o) and x in (select x from t) union select x from o where x not in (select x from b) union select x from t where x not in (select x from b)"""
)
def u03_merge_sets(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_type", "x")
    return merge.merge_sets(part.where("p_size % 2 = 0").select("x").distinct(), part.where("p_partkey % 3 = 0").select("x").distinct(), part.where("p_size % 5 <> 1").select("x").distinct())


EDITS_SQL = """edits as (select l_orderkey k, l_orderkey * 10 + l_linenumber seq, case when l_linenumber % 4 = 3 then 'delete' else 'put' end op, 8 m, l_returnflag s, cast(round(l_extendedprice * 100) as bigint) c
  from lineitem where l_orderkey % 6 = 1),
last as (select k, op, m, s, c from (select *, row_number() over (partition by k order by seq desc, op desc, m desc, s desc, c desc) r from edits) where r = 1)"""


def edits(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").where("l_orderkey % 6 = 1")
    return lines.selectExpr(
        "l_orderkey k", "l_orderkey * 10 + l_linenumber seq", "case when l_linenumber % 4 = 3 then 'delete' else 'put' end op", "8 m", "l_returnflag s", "cast(round(l_extendedprice * 100) as bigint) c"
    )


@query(f"with {EDITS_SQL} select * from last")
def k07_coalesce_edits(spark, sf):
    return d.coalesce_edits(edits(spark, sf), "k", "seq", VALUES)


@query(f"with {VERSIONS}, {EDITS_SQL} select k, m, s, c from base where k not in (select k from last) union all select k, m, s, c from last where op = 'put'")
def w01_upsert(spark, sf):
    return d.upsert(base(spark, sf), d.coalesce_edits(edits(spark, sf), "k", "seq", VALUES), "k", VALUES)


# Reads.


@query("select * from customer where c_custkey = 77")
def s01_point_get(spark, sf):
    return table(spark, sf, "customer").where("c_custkey = 77")


@query("select o_orderkey, o_orderstatus from orders where o_orderkey >= 500 and o_orderkey < 900 order by o_orderkey")
def s02_range_scan(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey >= 500 and o_orderkey < 900").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey")


@query("select substr(c_name, 11) \"name\", c_custkey from customer where c_name like 'Customer#0%'")
def s03_prefix_scan(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_name").startswith("Customer#0")).select(F.substring("c_name", 11, 1000).alias("name"), "c_custkey")


@query(f"with {VERSIONS} select count(*) n, count(distinct c) contents from ours")
def s04_count(spark, sf):
    return ours(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("c").alias("contents"))


@query("select c_name from customer where c_name > 'Customer#000000100' and c_name like 'Customer#%' order by c_name limit 1000")
def s17_list_page(spark, sf):
    return table(spark, sf, "customer").where((F.col("c_name") > "Customer#000000100") & F.col("c_name").startswith("Customer#")).select("c_name").orderBy("c_name").limit(1000)


@query(
    """select o_orderkey, sha256(concat(strlen(cast(o_orderkey as varchar)), ':', o_orderkey, strlen(cast(o_custkey as varchar)), ':', o_custkey, strlen(o_orderstatus), ':', o_orderstatus,
      strlen(cast(cast(round(o_totalprice * 100) as bigint) as varchar)), ':', cast(round(o_totalprice * 100) as bigint))) row_hash,
    substr(sha256(cast(o_orderkey as varchar)), 1, 12) short from orders"""
)
def c07_row_identity(spark, sf):
    orders = table(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return orders.select("o_orderkey", hashing.row_hash(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), cents).alias("row_hash"), hashing.short(hashing.content_hash(F.col("o_orderkey").cast("string"))).alias("short"))


# Names.

URL_NAMES = "regexp_replace(url, '^https?://', '')"


@query(
    """with p as (select page_id, regexp_replace(url, '^https?://', '') path from pages), q as (select *, string_split(path, '/') seg from p)
    select page_id, len(list_filter(seg, lambda x: strlen(x) < 1 or strlen(x) > 255 or x in ('.', '..'))) = 0 and len(seg) <= 64 and strlen(path) <= 4096 valid from q"""
)
def f01_valid_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", grammar.valid_path(F.regexp_replace("url", "^https?://", "")).alias("valid"))


NAME_CASES = "case c_custkey % 7 when 0 then concat('feature/', c_mktsegment) when 1 then concat('a..', c_name) when 2 then concat(c_mktsegment, '.lock') when 3 then concat(c_name, '/') when 4 then concat('x//', c_mktsegment) when 5 then concat(lower(c_mktsegment), '/.', c_name, '.lock/x') else c_name end"


@query(
    f"""with n as (select c_custkey, {NAME_CASES} "name" from customer) select c_custkey, "name", regexp_matches("name", '^[A-Za-z0-9][A-Za-z0-9._/-]{{0,127}}$')
    and not regexp_matches("name", '\\.\\.|//|/$|\\.lock$') valid from n"""
)
def f02_valid_ref(spark, sf):
    names = table(spark, sf, "customer").select("c_custkey", F.expr(NAME_CASES).alias("name"))
    return names.withColumn("valid", grammar.valid_ref(F.col("name")))


@query(
    f"""with n as (select c_custkey, lower({NAME_CASES}) "name" from customer)
    select c_custkey, regexp_matches("name", '^[a-z0-9_-][a-z0-9._-]{{0,127}}(/[a-z0-9_-][a-z0-9._-]{{0,127}}){{0,7}}$') and strlen("name") <= 512 valid from n"""
)
def f03_valid_object_name(spark, sf):
    names = table(spark, sf, "customer").select("c_custkey", F.lower(F.expr(NAME_CASES)).alias("name"))
    return names.select("c_custkey", grammar.valid_object_name(F.col("name")).alias("valid"))


@query(
    """with g as (select concat('user:', c_custkey) principal, 'write' "action", substr(c_mktsegment, 1, 1 + c_custkey % 3) prefix from customer where c_custkey % 4 <> 0),
    ch as (select distinct concat('user:', o_custkey) principal, 'write' "action", concat(c.c_mktsegment, '/', o_orderpriority) "path" from orders join customer c on c_custkey = (o_custkey + o_orderkey % 2))
    select ch.*, coalesce(bool_or(starts_with(ch."path", g.prefix)), false) allowed from ch left join g on ch.principal = g.principal and ch."action" = g."action" group by all"""
)
def f05_authorize(spark, sf):
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    grants = customer.where("c_custkey % 4 <> 0").selectExpr("concat('user:', c_custkey) principal", "'write' action", "substr(c_mktsegment, 1, cast(1 + c_custkey % 3 as int)) prefix")
    changes = orders.withColumn("c_custkey", F.expr("o_custkey + o_orderkey % 2")).join(customer, "c_custkey")
    return store.allowed(changes.selectExpr("concat('user:', o_custkey) principal", "'write' action", "concat(c_mktsegment, '/', o_orderpriority) path").distinct(), grants)


@query(
    """select o_orderkey, lower(hex(o_orderkey % 256)) || lower(hex(o_orderkey // 256 % 256)) low16_unpadded,
    case when o_orderkey < 128 then 1 when o_orderkey < 16384 then 2 when o_orderkey < 2097152 then 3 else 4 end varint_bytes from orders"""
)
def f07_codecs(spark, sf):
    k = F.col("o_orderkey")
    two = F.lower(F.hex(codec.little_endian(k % 65536, 2)))
    unpadded = F.concat(*(F.regexp_replace(F.substring(two, i, 2), "^0(.)", "$1") for i in (1, 3)))
    return table(spark, sf, "orders").select("o_orderkey", unpadded.alias("low16_unpadded"), F.octet_length(codec.uvarint(k)).alias("varint_bytes"))


@query("select doc_id, coalesce(text, '') opened, 28 overhead from documents")
def f10_seal_and_open(spark, sf):
    key, iv = F.lit(b"0123456789abcdef0123456789abcdef"), F.substring(F.unhex(F.sha2(F.col("doc_id").cast("string"), 256)), 1, 12)
    plain = F.coalesce("text", F.lit(""))
    sealed = table(spark, sf, "documents").select("doc_id", plain.alias("plain"), F.aes_encrypt(plain.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), iv, F.lit("chunk")).alias("sealed"))
    return sealed.select("doc_id", F.aes_decrypt("sealed", key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("chunk")).cast("string").alias("opened"), (F.octet_length("sealed") - F.octet_length("plain")).alias("overhead"))


# History: the orders of two customers each are commits, in order of date and key.

COMMITS_SQL = """o as (select o_orderkey id, o_custkey cust, o_custkey // 2 grp, o_orderdate d from orders),
r as (select *, row_number() over (partition by grp order by d, id) - 1 height, lag(id) over (partition by cust order by d, id) p1, lag(id) over (partition by grp order by d, id) p2 from o),
edges as (select id, p1 parent from r where p1 is not null union select id, p2 from r where p2 is not null and id % 3 = 0),
tips as (select cust start, arg_max(id, height) id from r group by cust),
reach as (select start, id from tips union select reach.start, e.parent from reach join edges e on e.id = reach.id),
reached as (select reach.start, reach.id, r.height from reach join r on r.id = reach.id)"""


def commit_graph(spark: SparkSession, sf: str) -> DataFrame:
    """id, cust, grp, parents, height: a commit for each order."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.expr("o_custkey div 2").alias("grp"), F.col("o_orderdate").alias("d"))
    by_group, by_customer = Window.partitionBy("grp").orderBy("d", "id"), Window.partitionBy("grp", "cust").orderBy("d", "id")  # of one shuffle: a customer has one group
    second = F.when(F.col("id") % 3 == 0, F.lag("id").over(by_group))
    parents = F.array_distinct(F.array_compact(F.array(F.lag("id").over(by_customer), second)))
    return o.select("id", "cust", "grp", parents.alias("parents"), (F.row_number().over(by_group) - 1).cast("long").alias("height"))


def tips(commits: DataFrame) -> DataFrame:
    return commits.groupBy(F.col("cust").alias("start")).agg(F.max_by("id", "height").alias("id"))


@query(f"with recursive {COMMITS_SQL} select start, id, height from reached")
def g01_history_closure(spark, sf):
    commits = stored(commit_graph(spark, sf), "commits")
    return history.closure(commits, tips(commits))


@query(f"with recursive {COMMITS_SQL} select * from (select start, id, height, row_number() over (partition by start order by height desc, id) place from reached) where place <= 10")
def k01_log(spark, sf):
    commits = stored(commit_graph(spark, sf), "commits")
    return history.logs(commits, tips(commits), 10)


@query(
    f"""with recursive {COMMITS_SQL}, pairs as (select min(start) a, max(start) b from tips group by start // 2 having count(*) = 2),
    common as (select p.a, p.b, x.id, x.height from pairs p join reached x on x.start = p.a join reached y on y.start = p.b and y.id = x.id)
    select a, b, height, base from (select a, b, height, id base, row_number() over (partition by a, b order by height desc, id) n from common) where n = 1"""
)
def k02_merge_base(spark, sf):
    commits = stored(commit_graph(spark, sf), "commits")
    starts = tips(commits)
    pairs = starts.groupBy(F.expr("start div 2").alias("g")).agg(F.min("start").alias("a"), F.max("start").alias("b"), F.count("*").alias("n")).where("n = 2").select("a", "b")
    return history.nearest_bases(commits, starts, pairs)


# Packs: 64 orders a pack; a chunk is a part, and a part's lines repeat it.

ENTRIES_SQL = """entries as (select sha256(cast(l_partkey as varchar)) hash, l_orderkey // 64 pack, l_orderkey * 10 + l_linenumber seq, cast(l_quantity * 16 as bigint) bytes, l_partkey part from lineitem),
condemned as (select distinct pack, 1000 + pack % 40 condemned_at from entries where pack % 5 = 0),
live as (select sha256(cast(p_partkey as varchar)) hash from part where p_size % 5 < 2)"""
PACKS_SQL = f"""{ENTRIES_SQL}, packs as (select pack, count(*) n, sum(bytes) bytes, count(*) filter (hash in (select hash from live)) live_n, coalesce(sum(bytes) filter (hash in (select hash from live)), 0) live_bytes
  from entries group by pack)"""


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        hashing.content_hash(F.col("l_partkey").cast("string")).alias("hash"), F.expr("l_orderkey div 64").alias("pack"), F.expr("l_orderkey * 10 + l_linenumber").alias("seq"), (F.col("l_quantity") * 16).cast("long").alias("bytes")
    )


def condemned(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).where("pack % 5 = 0").select("pack", (1000 + F.col("pack") % 40).alias("condemned_at")).distinct()


def live(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_size % 5 < 2").select(hashing.content_hash(F.col("p_partkey").cast("string")).alias("hash"))


@query(f"with {ENTRIES_SQL}, w as (select p_partkey, sha256(cast(p_partkey * 2 as varchar)) hash from part) select hash, hash in (select hash from entries) stored from w")
def s15_has(spark, sf):
    wanted = table(spark, sf, "part").select(hashing.content_hash((F.col("p_partkey") * 2).cast("string")).alias("hash"))
    return store.has(wanted, entries(spark, sf))


@query(
    f"""with {ENTRIES_SQL}, w as (select distinct sha256(cast(p_partkey * 2 as varchar)) hash from part)
    select hash from w where hash not in (select hash from entries where pack not in (select pack from condemned))"""
)
def d08_new_chunks(spark, sf):
    incoming = table(spark, sf, "part").select(hashing.content_hash((F.col("p_partkey") * 2).cast("string")).alias("hash"))
    return store.new_chunks(incoming, entries(spark, sf), condemned(spark, sf))


@query(
    f"""with {ENTRIES_SQL} select hash, pack, seq, out = 1 condemned from (select e.*, case when c.pack is null then 0 else 1 end out,
    row_number() over (partition by hash order by case when c.pack is null then 0 else 1 end, e.pack, seq) r from entries e left join condemned c on c.pack = e.pack) where r = 1"""
)
def d11_first_location(spark, sf):
    return store.first_locations(entries(spark, sf), condemned(spark, sf))


@query(f"with {PACKS_SQL} select pack, n, cast(bytes as bigint) bytes, live_n, cast(live_bytes as bigint) live_bytes from packs")
def d07_pack_liveness(spark, sf):
    return store.liveness(entries(spark, sf), live(spark, sf))


@query(
    f"""with {PACKS_SQL} select p.pack, live_n, case when condemned_at is null then case when live_n = 0 then 'condemn' else 'keep' end when live_n > 0 then 'reprieve' when 1030 - condemned_at >= 20 then 'expire' else 'wait' end state
    from packs p left join condemned c on c.pack = p.pack"""
)
def gc2_states(spark, sf):
    return store.gc_states(store.liveness(entries(spark, sf), live(spark, sf)), condemned(spark, sf), 1030, 20)


@query(
    f"""with {PACKS_SQL}, c as (select *, live_bytes / bytes share from packs where live_n > 0 and live_n < n and live_bytes / bytes < 0.5),
    s as (select pack, n, bytes, live_n, live_bytes, coalesce(sum(live_bytes) over (order by share, pack rows between unbounded preceding and 1 preceding), 0) copied_before from c)
    select pack, n, cast(bytes as bigint) bytes, live_n, cast(live_bytes as bigint) live_bytes, cast(copied_before as bigint) copied_before from s where copied_before < 200000"""
)
def k03_repack_selection(spark, sf):
    return store.repack(store.liveness(entries(spark, sf), live(spark, sf)), 200_000)


@query(
    """with o as (select concat('o', o_orderkey) "name", o_orderkey modified from orders), named as (select concat('o', l_orderkey) "name" from lineitem where l_linenumber = 3), rec as (select concat('o', o_orderkey) "name" from orders where o_orderkey % 10 = 0)
    select "name", modified from o where (select max(o_orderkey) from orders) * 10 // 11 >= modified and "name" not in (select "name" from named) and "name" not in (select "name" from rec)"""
)
def d09_orphans(spark, sf):
    orders = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("name"), F.col("o_orderkey").alias("modified"))
    named = table(spark, sf, "lineitem").where("l_linenumber = 3").select(F.concat(F.lit("o"), "l_orderkey").alias("name"))
    last = orders.agg(F.max("modified")).first()[0] or 0
    return store.orphans(orders, named, orders.where("modified % 10 = 0"), last, last - last * 10 // 11)


@query(
    """with i as (select c_custkey, cast(128 + 64 * abs(c_custkey * 7919 % 4001) as bigint) size from customer), t as (select *, case when size <= 1024 then 0 else cast(ceil(ln(size / 1024.0) / ln(8)) as integer) end tier from i),
    g as (select tier, count(*) n, cast(sum(size) as bigint) size from t group by tier) select tier, n, size, coalesce(tier = (select min(tier) from g where n >= 8), false) "merge" from g"""
)
def w17_compaction_tiers(spark, sf):
    sizes = table(spark, sf, "customer").select((128 + 64 * F.abs(F.col("c_custkey") * 7919 % 4001)).cast("long").alias("size"))
    return store.compaction_tiers(sizes)


STREAM_SQL = 'c as (select l_orderkey stream, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax) seq, cast(l_quantity as bigint) bytes from lineitem), f as (select *, sum(bytes) over (partition by stream order by seq) "end" from c)'


def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    place = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax)"
    return table(spark, sf, "lineitem").selectExpr("l_orderkey stream", f"cast({place} as bigint) seq", "cast(l_quantity as bigint) bytes")


@query(f'with {STREAM_SQL} select stream, seq, bytes, cast("end" as bigint) "end", cast("end" - bytes as bigint) "start" from f')
def k06_offsets(spark, sf):
    return store.offsets(stream_chunks(spark, sf))


@query(
    f"""with {STREAM_SQL}, g as (select stream, seq, "end" - bytes "start", "end", o_orderkey % 50 off, 40 n from f join orders on o_orderkey = stream where o_orderkey % 3 = 0)
    select stream, off, n, seq, cast(greatest("start", off) - "start" as bigint) "from", cast(least("end", off + n) - "start" - (greatest("start", off) - "start") as bigint) length from g where off < "end" and off + n > "start\""""
)
def s08_read_at(spark, sf):
    reads = table(spark, sf, "orders").where("o_orderkey % 3 = 0").selectExpr("o_orderkey stream", "o_orderkey % 50 off", "40 n")
    return store.read_at(stream_chunks(spark, sf), reads)


@query(
    """with j as (select user_id segment, event_id seq, case when event_id % 9 = 0 then 'gap' else cast(lag(event_id) over (partition by user_id order by event_id) as varchar) end expected, cast(event_id as varchar) next from events)
    select * from (select *, lag(next) over (partition by segment order by seq) before from j) where before is not null and before <> expected"""
)
def w18_journal_chain(spark, sf):
    from pyspark.sql import Window

    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).cast("string")
    records = table(spark, sf, "events").select(F.col("user_id").alias("segment"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 9 == 0, "gap").otherwise(before).alias("expected"), F.col("event_id").cast("string").alias("next"))
    return store.chain_breaks(records)


@query(
    """with v as (select concat('vol-', n_nationkey) volume from nation), s as (select p_partkey, volume, substr(sha256(concat(volume, chr(31), 'part-', p_partkey)), 1, 16) score from part, v)
    select concat('part-', p_partkey) "name", volume, score, rank from (select *, row_number() over (partition by p_partkey order by score desc, volume) rank from s) where rank <= 2"""
)
def k04_rendezvous(spark, sf):
    names = table(spark, sf, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("name"))
    volumes = table(spark, sf, "nation").select(F.concat(F.lit("vol-"), "n_nationkey").alias("volume"))
    return store.rendezvous(names, volumes).where("rank <= 2")


@query(
    """with recursive e as (select concat('c', c_custkey) parent, concat('o', o_orderkey) child from customer join orders on o_custkey = c_custkey union all select concat('o', l_orderkey), concat('p', l_partkey) from lineitem
      union all select concat('n', n_nationkey), concat('c', c_custkey) from nation join customer on c_nationkey = n_nationkey),
    reach as (select concat('n', n_nationkey) node from nation where n_regionkey = 2 union select child from reach join e on parent = node) select node from reach"""
)
def g02_mark(spark, sf):
    t = lambda name: table(spark, sf, name)
    node = lambda kind, key: F.concat(F.lit(kind), key)
    edges = (
        t("orders").select(node("c", "o_custkey").alias("parent"), node("o", "o_orderkey").alias("child"))
        .union(t("lineitem").select(node("o", "l_orderkey"), node("p", "l_partkey")))
        .union(t("customer").select(node("n", "c_nationkey"), node("c", "c_custkey")))
    )
    return store.mark(edges, t("nation").where("n_regionkey = 2").select(node("n", "n_nationkey").alias("node")))


# Segmentation.

SPLIT_SQL = """with recursive e as (select c_nationkey grp, row_number() over (partition by c_nationkey order by c_custkey) - 1 n, 300 + c_custkey * 37 % 900 size, cast(concat('0x', substr(sha256(cast(c_custkey as varchar)), 1, 8)) as bigint) w from customer),
f as (select grp, n, size z, false ends, 0 used from e where false
  union all select grp, n, size, size >= 512 and (size >= 16384 or (w::hugeint + 1) * 417031985092321 <= (size::hugeint ** 4)::hugeint * 4294967296), 0 from e where n = 0
  union all select e.grp, e.n, a, a >= 512 and (a >= 16384 or (e.w::hugeint + 1) * 417031985092321 <= (a::hugeint * a * a * a - b::hugeint * b * b * b) * 4294967296), 0
  from (select e.*, case when f.ends then 0 else f.z end b, case when f.ends then 0 else f.z end + e.size a from f join e on e.grp = f.grp and e.n = f.n + 1) e)
select grp, n from f where ends"""


@query(SPLIT_SQL.replace("(size::hugeint ** 4)::hugeint", "(size::hugeint * size * size * size)"))
def c01_node_ends(spark, sf):
    customer = table(spark, sf, "customer")
    rows = customer.select(F.col("c_nationkey").alias("grp"), "c_custkey", (300 + F.col("c_custkey") * 37 % 900).alias("size"), hashing.window(hashing.content_hash(F.col("c_custkey").cast("string")), 0).alias("w"))
    return segment.node_ends(rows, "grp", "c_custkey", "size", "w").select("grp", F.explode("ends").alias("n")).withColumn("n", F.col("n").cast("long"))


@query()
def c03_document_chunks(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("stream"), F.col("text").alias("data"))
    return segment.chunks(docs, least=256, most=4096, mask=0x3FF)


@query()
def a05_chunk_stats(spark, sf):
    chunks = c03_document_chunks(spark, sf)
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("hash").alias("distinct_chunks"), F.sum("bytes").alias("bytes"))


# Checks and small reads.

PRINCIPAL_CASES = "case c_custkey % 5 when 0 then concat('user:', c_name) when 1 then '' when 2 then concat('a', chr(10), c_name) when 3 then repeat('x', 257) else c_mktsegment end"


@query(f"with n as (select c_custkey, {PRINCIPAL_CASES} p from customer) select c_custkey, strlen(p) between 1 and 256 and not regexp_matches(p, '[\\x00-\\x1f\\x7f]') valid from n")
def f04_valid_principal(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", grammar.valid_principal(F.expr(PRINCIPAL_CASES)).alias("valid"))


HASH_CASES = "case o_orderkey % 4 when 0 then upper({h}) when 1 then substr({h}, 1, 63) when 2 then concat({h}, '0') else {h} end"


@query(f"select o_orderkey, regexp_matches({HASH_CASES.format(h='sha256(cast(o_orderkey as varchar))')}, '^[0-9a-f]{{64}}$') valid from orders")
def f06_parse_hash(spark, sf):
    text = F.expr(HASH_CASES.format(h="sha2(cast(o_orderkey as string), 256)"))
    return table(spark, sf, "orders").select("o_orderkey", hashing.is_hash(text).alias("valid"))


@query("select r_regionkey node, count(*) children, cast(sum(n) as bigint) n from region join nation on n_regionkey = r_regionkey join (select c_nationkey k, count(*) n from customer group by 1) on k = n_nationkey group by 1")
def a01_subtree_counts(spark, sf):
    leaves = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return leaves.join(table(spark, sf, "nation"), "n_nationkey").groupBy(F.col("n_regionkey").alias("node")).agg(F.count("*").alias("children"), F.sum("n").alias("n"))


@query("select o_orderkey stream, coalesce(n, 0) size, coalesce(n, 0) <> o_orderkey % 300 wrong from orders left join (select l_orderkey k, cast(sum(cast(l_quantity as bigint)) as bigint) n from lineitem group by 1) on k = o_orderkey")
def a02_stream_sizes(spark, sf):
    sizes = stream_chunks(spark, sf).groupBy("stream").agg(F.sum("bytes").alias("n"))
    claimed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("stream"), (F.col("o_orderkey") % 300).alias("claim"))
    size = F.coalesce("n", F.lit(0).cast("long"))
    return claimed.join(sizes, "stream", "left").select("stream", size.alias("size"), (size != F.col("claim")).alias("wrong"))


@query("select stream, n from (select l_orderkey stream, cast(sum(cast(l_quantity as bigint)) as bigint) n from lineitem group by 1) where n <= 60")
def s09_bounded_read(spark, sf):
    return stream_chunks(spark, sf).groupBy("stream").agg(F.sum("bytes").alias("n")).where("n <= 60")


@query(f"with {STREAM_SQL} select stream, string_agg(cast(bytes as varchar), '|' order by seq) content, count(*) chunks from f group by stream")
def s07_stream_read(spark, sf):
    ordered = F.sort_array(F.collect_list(F.struct("seq", F.col("bytes").cast("string").alias("b"))))
    return stream_chunks(spark, sf).groupBy("stream").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "|").alias("content"), F.count("*").alias("chunks"))


@query("select distinct l_partkey k from lineitem where l_returnflag = 'A' union select p_partkey from part where p_size < 10")
def u01_index_union(spark, sf):
    a = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k"))
    return a.union(table(spark, sf, "part").where("p_size < 10").select("p_partkey")).distinct()


@query(f"with {ENTRIES_SQL}, counted as (select sha256(cast(p_partkey + 100 as varchar)) hash, p_partkey from part) select p_partkey, hash from counted where hash not in (select hash from entries)")
def d10_not_survived(spark, sf):
    counted = table(spark, sf, "part").select("p_partkey", hashing.content_hash((F.col("p_partkey") + 100).cast("string")).alias("hash"))
    return counted.join(entries(spark, sf).select("hash").distinct(), "hash", "left_anti").select("p_partkey", "hash")


@query(
    f"""with {PACKS_SQL}, c as (select *, live_bytes / bytes share from packs where live_n > 0 and live_n < n and live_bytes / bytes < 0.5),
    s as (select pack, coalesce(sum(live_bytes) over (order by share, pack rows between unbounded preceding and 1 preceding), 0) copied from c),
    f as (select hash, pack from (select e.hash, e.pack, row_number() over (partition by e.hash order by case when c.pack is null then 0 else 1 end, e.pack, e.seq) r from entries e left join condemned c on c.pack = e.pack) where r = 1)
    select f.hash, f.pack from f join s on s.pack = f.pack where s.copied < 200000 and f.hash in (select hash from live)"""
)
def gc3_copied_chunks(spark, sf):
    chosen = store.repack(store.liveness(entries(spark, sf), live(spark, sf)), 200_000).select("pack")
    credited = store.first_locations(entries(spark, sf), condemned(spark, sf)).select("hash", "pack")
    return credited.join(chosen, "pack", "left_semi").join(live(spark, sf), "hash", "left_semi").select("hash", "pack")


# Namespaces: an object for each order; its lines are its entries.

OBJECTS_SQL = """reg as (select * from (values (1, 'blob', true, false), (2, 'tree', true, false), (3, 'counter', false, true)) v(model, name, walkable, accumulates)),
obj as (select case when o_orderkey % 17 = 0 then concat('a//', o_orderkey) else concat(lower(substr(o_orderpriority, 3)), '/', o_orderkey) end "path", cast(o_orderkey % 4 as bigint) model, case when o_orderkey % 11 = 0 then 2 else 1 end "format",
  case when o_orderkey % 13 = 0 then 1 else 0 end flags, case when o_orderkey % 7 = 0 then 1 else 0 end "depth", o_orderkey % 8 size, sha256(cast(o_orderkey as varchar)) root, o_orderkey from orders)"""


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "blob", True, False), (2, "tree", True, False), (3, "counter", False, True)], "model long, name string, walkable boolean, accumulates boolean")


def named_objects(spark: SparkSession, sf: str) -> DataFrame:
    path = "case when o_orderkey % 17 = 0 then concat('a//', o_orderkey) else concat(lower(substr(o_orderpriority, 3)), '/', o_orderkey) end path"
    rows = table(spark, sf, "orders").selectExpr(path, "o_orderkey % 4 model", "case when o_orderkey % 11 = 0 then 2 else 1 end format", "case when o_orderkey % 13 = 0 then 1 else 0 end flags", "case when o_orderkey % 7 = 0 then 1 else 0 end depth", "o_orderkey % 8 size", "sha2(cast(o_orderkey as string), 256) root", "o_orderkey")
    return rows.withColumn("ref", objects.encode_reference(*(F.col(c) for c in objects.FIELDS)))


@query(
    f"""with {OBJECTS_SQL}, w as (select case when o_orderkey % 5 = 0 then concat("path", 'x') else "path" end p, case when o_orderkey % 5 = 0 then null else o_orderkey end k from obj),
    j as (select p "path", case when o_orderkey % 17 = 0 or w.p like 'a//%' then 'invalid' when k is null then 'absent' when reg.name is null then 'unknown model' else 'ok' end state, reg.name, obj.* exclude ("path") from w left join obj on o_orderkey = k left join reg on reg.model = obj.model)
    select "path", state, name, {", ".join(f"case when state = 'ok' then cast({c} as {'varchar' if c == 'root' else 'bigint'}) end {c}" for c in ('model', '"format"', 'flags', '"depth"', 'size', 'root'))} from j"""
)
def s06_namespace_get(spark, sf):
    found = named_objects(spark, sf)
    wanted = found.select(F.when(F.col("o_orderkey") % 5 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"))
    return objects.lookup(found.select("path", "ref"), registry(spark), wanted)


@query(f"with {OBJECTS_SQL} select \"path\", obj.model, flags, case when o_orderkey % 17 = 0 then 'path' when flags <> 0 then 'flags' else 'model' end reason from obj left join reg on reg.model = obj.model where o_orderkey % 17 = 0 or flags <> 0 or reg.model is null")
def w06_refused_entries(spark, sf):
    return objects.refusals(named_objects(spark, sf), registry(spark))


@query(
    f"""with {OBJECTS_SQL}, a as (select * from obj where o_orderkey % 17 <> 0 and o_orderkey % 3 <> 0), b as (select "path", model, "format", flags, "depth", case when o_orderkey % 10 = 0 then size + 1 else size end size, root, o_orderkey from obj where o_orderkey % 17 <> 0 and o_orderkey % 5 <> 1)
    select case when a.root is null then 1 when b.root is null then 2 else 3 end kind, coalesce(a."path", b."path") "key", {", ".join(f'cast({s}.{c} as {t}) {p}_{n}' for n, c, t in (('model', 'model', 'bigint'), ('format', '"format"', 'bigint'), ('flags', 'flags', 'bigint'), ('depth', '"depth"', 'bigint'), ('size', 'size', 'bigint'), ('root', 'root', 'varchar')) for p, s in (('from', 'a'), ('to', 'b')))}
    from a full join b on a.o_orderkey = b.o_orderkey where a.root is null or b.root is null or a.size <> b.size"""
)
def d03_namespace_diff(spark, sf):
    found = named_objects(spark, sf).where("o_orderkey % 17 <> 0")
    size = F.when(F.col("o_orderkey") % 10 == 0, F.col("size") + 1).otherwise(F.col("size"))
    after = found.where("o_orderkey % 5 <> 1").withColumn("size", size).withColumn("ref", objects.encode_reference(*(F.col(c) for c in objects.FIELDS)))
    return objects.namespace_diff(found.where("o_orderkey % 3 <> 0").select("path", "ref"), after.select("path", "ref"))


@query(
    f"""with {OBJECTS_SQL}, l as (select l_orderkey k, count(*) n from lineitem group by 1) select o_orderkey "object", size, coalesce(n, 0) n, case when "format" <> 1 then 'format' when "depth" <> 0 then 'depth' else 'size' end reason
    from obj left join l on k = o_orderkey where "format" <> 1 or "depth" <> 0 or coalesce(n, 0) <> size"""
)
def s12_open_faults(spark, sf):
    claims = named_objects(spark, sf).select(F.col("o_orderkey").alias("object"), "format", "depth", "size")
    return objects.open_faults(claims, table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("object")).agg(F.count("*").alias("n")), 1)


@query(
    """with p as (select l_orderkey k, string_agg(l_returnflag || l_linestatus, '' order by l_linenumber, l_partkey, l_suppkey) v, 2 * count(*) n from lineitem group by 1)
    select o_orderkey "key", case when o_orderkey % 3 = 0 then o_orderstatus when n > 10 then null else v end "value", o_orderkey % 3 <> 0 and coalesce(n > 10, false) refused from orders left join p on k = o_orderkey"""
)
def s05_long_values(spark, sf):
    lines = table(spark, sf, "lineitem")
    sizes = lines.groupBy(F.col("l_orderkey").alias("stream")).agg((2 * F.count("*")).alias("size"))
    values = table(spark, sf, "orders").selectExpr("o_orderkey key", "case when o_orderkey % 3 = 0 then o_orderstatus end inline", "o_orderkey stream").join(sizes, "stream", "left")
    return objects.long_values(values, lines.select(F.col("l_orderkey").alias("stream"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.concat("l_returnflag", "l_linestatus").alias("data")), 10)


@query(
    f"""with {OBJECTS_SQL} select o_orderkey "object", root from obj where model in (1, 2) union select l_orderkey, sha256(cast(l_partkey as varchar)) from lineitem where l_orderkey % 4 = 2"""
)
def g05_walk(spark, sf):
    found = named_objects(spark, sf).where("model in (1, 2)").select(F.col("o_orderkey").alias("object"), "model", "root")
    return objects.walk(found, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("object"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("root")), registry(spark))


MODELS_SQL = "select p_size % 40 model, p_brand name, bool_or(p_retailprice > 1500) accumulates from part group by all"


@query(f"with r as ({MODELS_SQL}) select model, count(*) names from r group by 1 having count(*) > 1")
def a09_duplicate_models(spark, sf):
    return objects.duplicate_models(table(spark, sf, "part").selectExpr("p_size % 40 model", "p_brand name"))


@query(f"with r as ({MODELS_SQL}) select name, bool_or(accumulates) accumulates from r group by name")
def a08_accumulates(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.bool_or(F.col("p_retailprice") > 1500).alias("accumulates"))


@query(
    f"""with {PACKS_SQL}, s as (select case when c.condemned_at is null then case when live_n = 0 then 'condemn' else 'keep' end when live_n > 0 then 'reprieve' when 1030 - c.condemned_at >= 20 then 'expire' else 'wait' end state from packs left join condemned c on c.pack = packs.pack)
    select count(*) packs, {", ".join(f"count(*) filter (state = '{x}') {x}" for x in ("keep", "condemn", "reprieve", "wait", "expire"))}, (select count(*) from entries where pack % 9 = 0) copied, (select cast(coalesce(sum(bytes), 0) as bigint) from entries where pack % 9 = 0) copied_bytes from s"""
)
def a06_round_report(spark, sf):
    states = store.gc_states(store.liveness(entries(spark, sf), live(spark, sf)), condemned(spark, sf), 1030, 20)
    return store.round_report(states, entries(spark, sf).where("pack % 9 = 0"))


def prefer_x(column, b, o, t):
    """Statuses: an X wins, but where the base was open the two are in conflict; other columns: the greater."""
    return (o, b == "O") if column == "s" else (F.greatest(o, t), F.lit(False))


RESOLVER_SQL = classes_sql("alike", "o_s <> b_s and t_s <> b_s and o_s <> t_s and b_s = 'O'")


@query(merged_sql(RESOLVER_SQL, "case when o_c = b_c then t_c when t_c = b_c or o_c > t_c then o_c else t_c end"))
def m07_user_resolver(spark, sf):
    strategy = merge.Resolver(decide=prefer_x)
    return merge.merge(base(spark, sf), ours(spark, sf), theirs(spark, sf), "k", VALUES, "m", strategy, max_conflicts=None)[0]


@query("select p_size \"key\", count(*) n, max(strlen(p_name)) \"location\", max(strlen(p_type)) reason from part group by 1 having count(*) > 4 or max(strlen(p_name)) > 60 or max(strlen(p_type)) > 30")
def m11_record_faults(spark, sf):
    conflicts = table(spark, sf, "part").select(F.col("p_size").alias("key"), F.col("p_name").alias("location"), F.col("p_type").alias("reason"))
    return merge.record_faults(conflicts, 4, 60, 30)
