"""The registered queries as SQL over the same tables, for comparison.

Statements are written out per table column, without going through JSON, and
vectors are built from rows, without arrays; so the two sides share no method.
"""

from __future__ import annotations

from ..functions.vectors import V1_NUMBER


def _number(x: str) -> str:
    """Text of a DOUBLE the way a JSON number without trailing zeros reads."""
    return f"regexp_replace(cast({x} as varchar), '\\.0$', '')"


# --- statements of the order documents -----------------------------------------

_ORDER = """o as (select cast(o_orderkey as varchar) as doc_id, o_custkey as cust,
  o_orderstatus as status, o_totalprice as total, o_custkey % 3 as code,
  strftime(o_orderdate, '%Y-%m-%d') as day_text, year(o_orderdate) as y,
  month(o_orderdate) as m, day(o_orderdate) as d, o_orderpriority as prio,
  split_part(o_orderpriority, '-', 1) as p0, split_part(o_orderpriority, '-', 2) as p1
  from orders)"""


def order_rows(dialect="v2", skip_nulls=True, sets=False, exclude=()) -> list[tuple]:
    """(kind, name, key, cargo, base, condition) of each statement of an order."""
    v1 = dialect == "v1"
    nonzero = "{} <> 0" if skip_nulls and not v1 else "true"
    total = "true" if not skip_nulls else "total <> 0"
    code = nonzero.format("code")
    kids = f"(case when {total} then 1 else 0 end + case when {code} then 1 else 0 end)"
    rows = [
        ("object", "'sroot'", "'scustomer'", "'i' || cust", "'i0'", nonzero.format("cust")),
        ("object", "'sroot'", "'sstatus'", "'s' || status", "'i0'", "true"),
        ("object", "'sroot'", "'sdates'", "'i2'", "'i0'", "true"),
        ("object", "'sroot'", "'spriority'", "'s' || prio", "'i0'", "true"),
        ("object", "'sroot'", "'sparts'", "'i2'", "'i0'", "true"),
        ("object", "'sroot'", "'szero'", "'i0'", "'i0'", "true" if v1 or not skip_nulls else "false"),
    ]
    if not skip_nulls:
        rows.append(("object", "'sroot'", "'snothing'", "'u'", "'i0'", "true"))
    if "empty" not in exclude and not v1:
        rows.append(("object", "'sroot'", "'sempty'", "'u'", "'i0'", "true"))
    if "price" not in exclude:
        counted = f"'i' || {kids}"
        if not v1:
            counted = f"case when {kids} = 0 then 'u' else 'i' || {kids} end"
        rows += [
            ("object", "'sroot'", "'sprice'", counted, "'i0'", "true"),
            ("object", "'sprice'", "'stotal'", f"'f' || {_number('total')}", "'sprice'", total),
            ("object", "'sprice'", "'scode'", "'i' || code", "'sprice'", code),
        ]
    parts = [c for c in (("year", "y"), ("month", "m"), ("day", "d")) if c[0] not in exclude]
    date = f"'i{len(parts)}'"
    under = "'i0'" if sets else "'i1'"
    rows += [("object", "'i1'", f"'s{k}'", f"'i' || {c}", under, "true") for k, c in parts]
    if sets:
        rows += [
            ("set", "'sdates'", "'i0'", "'s' || day_text", "'sdates'", "true"),
            ("set", "'sdates'", "'i1'", date, "'sdates'", "true"),
            ("set", "'sparts'", "'i0'", "'s' || p0", "'sparts'", "p0 not in ('', '0')"),
            ("set", "'sparts'", "'i1'", "'s' || p1", "'sparts'", "p1 not in ('', '0')"),
        ]
    else:
        rows += [
            ("array", "'sdates'", "'i0'", "'s' || day_text", "'sdates'", "true"),
            ("array", "'sdates'", "'s' || day_text", date, "'sdates'", "true"),
            ("array", "'sdates'", date, "'i2'", "'sdates'", "true"),
            ("array", "'sparts'", "'i0'", "'s' || p0", "'sparts'", "true"),
            ("array", "'sparts'", "'s' || p0", "'s' || p1", "'sparts'", "true"),
            ("array", "'sparts'", "'s' || p1", "'i2'", "'sparts'", "true"),
        ]
    return rows


def order_statements(**options) -> str:
    """CTEs ending in st(doc_id, kind, name, key, cargo, base)."""
    rows = [
        f"select doc_id, '{kind}' as kind, {name} as name, {key} as key, {cargo} as cargo, "
        f"{base} as base from o where {when}"
        for kind, name, key, cargo, base, when in order_rows(**options)
        if when != "false"
    ]
    return f"{_ORDER}, st as ({' union all '.join(rows)})"


def triples_sql(where: str = "true", **options) -> str:
    texts = ", ".join(
        f"case when {c} <> 'u' then substr({c}, 2) end as {c}" for c in ("name", "key", "cargo", "base")
    )
    return f"with {order_statements(**options)} select doc_id, kind, {texts} from st where {where}"


# --- token vectors --------------------------------------------------------------


def _cell(x: str, length: int, dialect: str) -> str:
    x = x if dialect == "v1" else f"trunc({x})"
    return f"cast(trunc({x} - {length} * floor(({x}) / {length}.0)) as int) % {length}"


def vector_ctes(
    length: int, dialect="v2", numeric="ME", string="decay", text_numbers=True
) -> str:
    """CTEs from tok(token) to vec(token, i, v)."""
    pattern = V1_NUMBER.strip("^$") if dialect == "v1" else (
        r"\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?)\s*"
    )
    looks = f"(typ = 's' and regexp_full_match(txt, '{pattern}'))" if text_numbers else "false"
    if dialect == "v1":
        mantissa, exponent = "n / pow(10, trunc(log10(abs(n))))", "trunc(log10(abs(n)))"
        first = "false"
    else:
        mantissa = "cast(split_part(format('{:e}', n), 'e', 1) as double)"
        exponent = "cast(split_part(format('{:e}', n), 'e', 2) as double)"
        first = "(typ = 'u' or (typ = 's' and txt = '') or (typ = 's' and is_num and n = 0 and txt <> '0'))"
    away = "case when {0} > 0 then {0} + 1 else {0} - 1 end"

    def spread(src, p, w):
        return [
            f"select token, {_cell(p, length, dialect)} as i, {w} * (1 - abs({p} - trunc({p}))) as v from {src}",
            f"select token, {_cell('(' + away.format(p) + ')', length, dialect)} as i, {w} * abs({p} - trunc({p})) as v from {src}",
        ]

    if numeric == "ME":
        numbers = spread("num", "p", "0.5")
        numbers.append(f"select token, {_cell('x', length, dialect)} as i, 0.5 as v from num")
    elif numeric == "ML":
        logged = "(select * from num where n > 0)" if dialect == "v1" else "num"
        numbers = spread("num", "p", "1.0") + spread(logged, "ln(abs(n))", "1.0")
    elif numeric == "smooth":
        numbers = [
            f"select token, {_cell('n', length, dialect)} as i, 1 - (n - trunc(n)) as v from num",
            f"select token, {_cell('(n + 1)', length, dialect)} as i, n - trunc(n) as v from num",
        ]
    else:
        numbers = [f"select token, {_cell('n', length, dialect)} as i, 1.0 as v from num"]
    if string == "decay":
        # running means within 256 characters, and what the two stretches before leave of theirs
        run = """inb as (select token, k, o, k // 256 as b, k % 256 as p,
  pow(0.9, k % 256) * sum(case when k = 0 then o else 0.1 * o * pow(0.9, -(k % 256)) end)
    over (partition by token, k // 256 order by k) as s from ords),
bend as (select token, b, arg_max(s, p) as s from inb group by token, b),
run as (select inb.token, k, o, inb.s + pow(0.9, p + 1)
  * (coalesce(x.s, 0) + pow(0.9, 256) * coalesce(y.s, 0)) as r from inb
  left join bend x on x.token = inb.token and x.b = inb.b - 1
  left join bend y on y.token = inb.token and y.b = inb.b - 2)"""
        s = f"(r * {length} / 10.0)"
    else:
        value = "case when k = 0 then o else o + lag(o) over (partition by token order by k) end"
        run = f"run as (select token, k, o, {value} as r from ords)"
        s = "r"
    # v2 takes the least cell only up to the first that is exactly 0
    least = "min(v)"
    if numeric == "smooth" and dialect == "v2":
        least = "case when arg_min(v, i) filter (where v <= 0) = 0 then 0 else min(v) end"
    strings = [
        f"select token, cast(o as int) % {length} as i, 1.0 as v from run where k = 0",
        f"select token, cast(floor({s}) as bigint) % {length} as i, 1 - ({s} - floor({s})) as v from run where k > 0",
        f"select token, cast(floor({s}) + 1 as bigint) % {length} as i, {s} - floor({s}) as v from run where k > 0",
    ]
    return f"""
tk as materialized (select row_number() over () as token, word, substr(word, 1, 1) as typ, substr(word, 2) as txt
  from (select distinct token as word from tok)),
tn as (select token, typ, txt, typ in ('i', 'f', 'b') or {looks} as is_num,
  case when typ = 'b' then cast(txt = 'true' as double) else try_cast(trim(txt) as double) end as n from tk),
num as (select token, n, {mantissa} / 10.0 * {length} as p, {exponent} as x from tn
  where is_num and n <> 0 and isfinite(n)),
chars as (select token, txt, unnest(range(length(txt))) as k from tn
  where typ = 's' and not is_num and txt <> ''),
ords as (select token, k, cast(unicode(substr(txt, k + 1, 1)) as double) as o from chars),
{run},
part as ({' union all '.join(numbers + strings)}
  union all select token, 0 as i, 1.0 as v from tn where {first}),
cell as (select token, i, sum(v) as v from part group by token, i),
grid as (select tn.token, g.i, coalesce(cell.v, 0) as v from tn
  cross join (select unnest(range({length})) as i) g
  left join cell on cell.token = tn.token and cell.i = g.i),
low as (select token, lo, whole - {length} * lo as total
  from (select token, {least} as lo, sum(v) as whole from grid group by token)),
vec as materialized (select tk.word as token, cast(grid.i as int) as i,
  case when total <> 0 then (v - lo) / total else v - lo end as v
  from grid join low on low.token = grid.token join tk on tk.token = grid.token)"""


_ROUND = "round({} + 1e-9, 6) + 0.0"


def token_sql(tokens: str, length=13, columns="token", **options) -> str:
    """Vector cells of the tokens of a query."""
    return (
        f"with tok as ({tokens}), {vector_ctes(length, **options)} "
        f"select {columns}, i, {_ROUND.format('v')} as v from vec"
    )


def combined_ctes(length: int, combine: str) -> str:
    """CTEs from parts and vec to cmb(base, key, cargo, i, v), per distinct statement."""
    step = int(combine == "average")
    three = f"""
trio as (select distinct base, key, cargo from parts),
one as materialized (select t.base, t.key, t.cargo, a.i, a.v as av from trio t join vec a on a.token = t.base),
two as materialized (select t.*, b.v as bv from one t join vec b
  on b.token = t.key and b.i = (t.i + {step}) % {length}),
tri as materialized (select t.*, c.v as cv from two t join vec c
  on c.token = t.cargo and c.i = (t.i + {2 * step}) % {length}),"""
    if combine == "average":
        return f"{three}\ncmb as (select base, key, cargo, i, (av + bv + cv) / 3 as v from tri)"
    return f"""{three}
raw as materialized (select base, key, cargo, i, pow((1 + abs(av * cos(av)))
  * (1 + abs(bv * cos(2 * bv))) * (1 + abs(cv * cos(3 * cv))), 1.0 / 3) - 1 as v from tri),
lows as (select base, key, cargo, min(v) as lo, sum(v) - {length} * min(v) as total
  from raw group by base, key, cargo),
cmb as materialized (select r.base, r.key, r.cargo, r.i,
  case when abs(total) > 1e-12 then (v - lo) / total else 0.0 end as v
  from raw r join lows l on l.base = r.base and l.key = r.key and l.cargo = r.cargo)"""


# parts: the statement tokens that are vectorised
_PARTS = """parts as (select doc_id, base, case when kind = 'set' then 'i0' else key end as key, cargo from st),
tok as (select base as token from parts union select key from parts union select cargo from parts)"""


def fingerprint_ctes(statements: str, length=13, combine="product", **options) -> str:
    """CTEs ending in fp(doc_id, i, v)."""
    return f"""{statements}, {_PARTS}, {vector_ctes(length, **options)},
{combined_ctes(length, combine)},
fp as (select p.doc_id, c.i, sum(c.v) as v from parts p
  join cmb c on c.base = p.base and c.key = p.key and c.cargo = p.cargo group by p.doc_id, c.i)"""


def fingerprint_sql(statements: str, length=13, combine="product", **options) -> str:
    ctes = fingerprint_ctes(statements, length, combine, **options)
    return f"with {ctes} select doc_id, i, {_ROUND.format('v')} as v from fp"


def zscored_sql(ctes: str, free: str = "stddev_samp") -> str:
    return f"""with {ctes},
st_of as (select doc_id, avg(v) as m, {free}(v) as s from fp group by doc_id)
select fp.doc_id, fp.i, {_ROUND.format("(fp.v - m) / case when s = 0 then 1 else s end")} as v
from fp join st_of on st_of.doc_id = fp.doc_id"""


def pca_sql(ctes: str, length: int, steps: int = 2000) -> str:
    """Two principal components of fp by power iteration, the second one on what the
    first leaves of the correlations."""
    cells = f"range(1, {length + 1})"

    def iterated(name, matrix):
        step = f"list_transform({cells}, lambda i: list_inner_product(m[i], v))"
        return f"""
{name}_steps(k, v) as (select 0, list_transform({cells}, lambda i: 1.0 / i::double)
  union all select k + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w)))
  from (select k, {step} as w from {name}_steps, {matrix} where k < {steps})),
{name}_last as (select v, list_max(list_transform(v, lambda x: abs(x))) as top from {name}_steps where k = {steps}),
{name} as (select case when list_contains(v, top) then v else list_transform(v, lambda x: -x) end as v from {name}_last)"""

    left = (
        f"list_transform({cells}, lambda i: list_transform({cells}, lambda j: "
        f"m[i][j] - list_inner_product(list_transform({cells}, lambda q: list_inner_product(m[q], v)), v) * v[i] * v[j]))"
    )
    return f"""with recursive {ctes},
sp as (select i, avg(v) as mean, stddev_samp(v) as dev from fp group by i),
zs as materialized (select doc_id, fp.i, case when dev > 1e-7 then (v - mean) / dev else 0.0 end as z from fp join sp on sp.i = fp.i),
zl as materialized (select doc_id, list(z order by i) as z from zs group by doc_id),
cr as (select a.i as i, b.i as j, sum(a.z * b.z) / (select count(*) - 1 from zl) as c
  from zs a join zs b on a.doc_id = b.doc_id group by a.i, b.i),
mat as materialized (select list(r order by i) as m from (select i, list(c order by j) as r from cr group by i)),
{iterated("pc_one", "mat")},
rest as materialized (select {left} as m from mat, pc_one),
{iterated("pc_two", "rest")}
select doc_id, cast(0 as int) as i, {_ROUND.format("list_inner_product(z, pc_one.v)")} as v from zl, pc_one
union all select doc_id, 1, {_ROUND.format("list_inner_product(z, pc_two.v)")} from zl, pc_two"""


# --- ranks and pairs of the embedding table -------------------------------------

_RANKS = """e as (select cast(vec_id as varchar) as id, cast(label as bigint) as label, vec_id,
  embedding from embeddings),
ec as (select id, unnest(range(len(embedding))) as i, unnest(embedding) as x from e),
rk as (select id, cast(i as int) as i, row_number() over (partition by id order by x, i) - 1 as r from ec),
rv as (select id, list(r order by i) as ranks from rk group by id),
cl as (select ranks, min(id) as rep, count(*) as n from rv group by ranks)"""

_CORR = "1.0 - 6.0 * {} / (64.0 * (64.0 * 64.0 - 1))"


def _class_pairs(left: str, right: str, on: str) -> str:
    gap = (
        "list_sum(list_transform(list_zip(a.ranks, b.ranks), "
        "lambda z: cast((z[1] - z[2]) * (z[1] - z[2]) as double)))"
    )
    return (
        f"select a.rep as q, b.rep as t, {_CORR.format(gap)} as corr, a.n * b.n as pairs "
        f"from {left} a join {right} b on {on}"
    )


_SELF = f"""{_RANKS}, cp as ({_class_pairs('cl', 'cl', 'a.rep < b.rep')}
  union all select rep, rep, 1.0, n * (n - 1) // 2 from cl where n > 1)"""

# queries are the vectors of label 0 (all of the table is the target)
_CROSS = f"""{_RANKS},
ql as (select ranks, min(rv.id) as rep, count(*) as n from rv join e on e.id = rv.id where e.label = 0 group by ranks),
cp as ({_class_pairs('ql', 'cl', 'true')})"""

# queries are the vectors of every third label, turned around
RAW = f"""{_RANKS},
nk as (select '-' || e.id as id, row_number() over (partition by e.id order by -ec.x, ec.i) - 1 as r, ec.i
  from ec join e on e.id = ec.id where label % 3 = 0),
nv as (select id, list(r order by i) as ranks from nk group by id),
ql as (select ranks, min(id) as rep, count(*) as n from nv group by ranks),
cp as ({_class_pairs('ql', 'cl', 'true')})"""

_PAIR_COLUMNS = "q, t, round(corr, 9) as corr, pairs"


def pair_sql(ctes: str, cutoff: float) -> str:
    return f"with {ctes} select {_PAIR_COLUMNS} from cp where corr >= {cutoff}"


def topk_sql(k: int) -> str:
    """The k best pairs; the vectors of the table are all different."""
    return (
        f"with {_SELF} select q, t, round(corr, 9) as corr from cp "
        f"order by cp.corr desc, q, t limit {k}"
    )


def order_pairs(length: int) -> str:
    """CTEs ending in cp(q, t, corr, pairs) for the fingerprints of the order documents."""
    square = sum(i * i for i in range(length))
    gap = f"(2 * {square} - 2 * list_inner_product(a.ranks, b.ranks))"
    return f"""{fingerprint_ctes(order_statements(), length)},
ork as (select doc_id, i, row_number() over (partition by doc_id order by round(v + 1e-9, 6), i) - 1 as r from fp),
orv as (select doc_id, list(cast(r as double) order by i) as ranks from ork group by doc_id),
cl as materialized (select ranks, min(doc_id) as rep, count(*) as n from orv group by ranks),
cp as (select a.rep as q, b.rep as t, 1.0 - 6.0 * {gap} / ({length}.0 * ({length}.0 * {length}.0 - 1)) as corr,
    a.n * b.n as pairs from cl a join cl b on a.rep < b.rep
  union all select rep, rep, 1.0, n * (n - 1) // 2 from cl where n > 1)"""


# --- small statement sets --------------------------------------------------------


def supplier_statements(numbers: str = "i") -> str:
    """st of the supplier records; ``numbers`` is the type letter of their numbers."""
    rows = [
        ("object", "'sroot'", "'sname'", "'s' || name", "'i0'", "true"),
        ("object", "'sroot'", "'snation'", f"case when nat = 0 then 'u' else 'i1' end", "'i0'", "true"),
        ("object", "'snation'", "'skey'", f"'{numbers}' || nat", "'snation'", "nat <> 0"),
        ("object", "'sroot'", "'scents'", f"'{numbers}' || cents", "'i0'", "cents <> 0"),
        ("object", "'sroot'", "'stags'", "'i2'", "'i0'", "true"),
        ("array", "'stags'", "'i0'", "'s' || t0", "'stags'", "true"),
        ("array", "'stags'", "'s' || t0", "'s' || t1", "'stags'", "true"),
        ("array", "'stags'", "'s' || t1", "'i2'", "'stags'", "true"),
    ]
    body = " union all ".join(
        f"select doc_id, '{kind}' as kind, {name} as name, {key} as key, {cargo} as cargo, {base} as base "
        f"from s where {when}"
        for kind, name, key, cargo, base, when in rows
    )
    return f"""s as (select 's' || s_suppkey as doc_id, s_name as name, s_nationkey as nat,
  cast(round(s_acctbal * 100) as bigint) as cents, split_part(s_name, '#', 1) as t0,
  split_part(s_name, '#', 2) as t1 from supplier), st as ({body})"""


def supplier_sql() -> str:
    return (
        f"with {supplier_statements()} select doc_id, substr(name, 2) as name, substr(key, 2) as key, "
        "case when cargo <> 'u' then substr(cargo, 2) end as cargo from st"
    )
