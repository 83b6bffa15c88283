"""Queries over the derived fixtures, one or more per operator, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.fixtures import load, oracle
from latticeflow.functions import scalars as S
from latticeflow.functions.cosmology import Cosmology
from latticeflow.operators import buffers as B
from latticeflow.operators import catalog as C
from latticeflow.operators import graph as G
from latticeflow.operators import mesh as M
from latticeflow.operators.stage import kept
from latticeflow.plans import voxel as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
N, LENGTH = 16, 16.0


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` may use the fixture views."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


_KNOTS = """knots as (select i, i*cast(4 as double)/999 as z from range(1000) t(i)),
cells as (select i, z, cast(4 as double)/999 as s from knots where i < 999),
f as (select i, z, s, list_sum(list_transform(range(0, 9), lambda k: (case when k in (0, 8) then 1 when k % 2 = 1 then 4 else 2 end) * 2997.92458::double
  / sqrt(0.31::double*power(1+z+s*k/8, 3) + 0.69::double))) * s/24 as part from cells),
tab as (select k.i, k.z, coalesce((select sum(part) from f where f.i < k.i), 0) as r from knots k)"""


@query("p1_distance_table", f"with {_KNOTS} select cast(i as bigint) as i, round(z, 9) as z, round(r, 5) as r from tab")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Cosmology(0.31)
    return rounded(rounded(spark.createDataFrame([(i, float(z), float(r)) for i, (z, r) in enumerate(zip(c.z, c.r))], "i long, z double, r double"), "z", digits=9), "r", digits=5)


_DIST = f"{_KNOTS}, seg as (select z as z0, r as r0, lead(z) over (order by i) as z1, lead(r) over (order by i) as r1 from tab), d as (select s.*, r0 + (r1-r0)*(redshift-z0)/(z1-z0) as dist from fx_sky s join seg on redshift >= z0 and redshift < z1)"


def _sky_xyz(spark: SparkSession, sf_dir: str, view: str = "fx_sky") -> DataFrame:
    c = Cosmology(0.31)
    out = load(spark, sf_dir, view).withColumn("dist", c.distance(F.col("redshift")))
    x, y, z = S.cartesian(F.col("ra"), F.col("dec"), F.col("dist"))
    return out.withColumns({"x": x, "y": y, "z": z})


@query("p2_p5_sky_to_cartesian", f"with {_DIST} select id, round(dist, 4) as dist, round(dist*cos(radians(dec))*cos(radians(ra)), 4) as x, round(dist*cos(radians(dec))*sin(radians(ra)), 4) as y, round(dist*sin(radians(dec)), 4) as z from d")
def p2_p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sky_xyz(spark, sf_dir), "dist", "x", "y", "z", digits=4).select("id", "dist", "x", "y", "z")


@query("p3_distance_to_redshift", f"with {_KNOTS}, seg as (select z as z0, r as r0, lead(z) over (order by i) as z1, lead(r) over (order by i) as r1 from tab), d as (select c_custkey as id, cast(100 + c_custkey % 4000 as double) as dist from customer) select id, dist, round(z0 + (dist-r0)*(z1-z0)/(r1-r0), 6) as redshift from d join seg on dist >= r0 and dist < r1")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (100 + F.col("c_custkey") % 4000).cast("double").alias("dist"))
    return far.select("id", "dist", F.round(Cosmology(0.31).redshift(F.col("dist")), 6).alias("redshift"))


@query("p4_hubble_rate", "select id, round(cast(67.6 as double)*sqrt(cast(0.31 as double)*power(1+redshift, 3)+cast(0.69 as double)), 6) as h from fx_sky")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "fx_sky").select("id", F.round(Cosmology(0.31).hubble(F.col("redshift")), 6).alias("h"))


@query(
    "p6_cartesian_to_sky",
    "with c as (select id, x-8 as x, y-8 as y, z-8.5::double as z from fx_tracers_box) select id, round(case when degrees(atan2(y, x)) < 0 then degrees(atan2(y, x))+360 else degrees(atan2(y, x)) end, 6) as ra, "
    "round(90-degrees(acos(z/sqrt(x*x+y*y+z*z))), 6) as dec, round(sqrt(x*x+y*y+z*z), 6) as dist from c where x*x+y*y+z*z > 0",
)
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "fx_tracers_box").select("id", (F.col("x") - 8).alias("x"), (F.col("y") - 8).alias("y"), (F.col("z") - 8.5).alias("z")).where("x*x + y*y + z*z > 0")
    ra, dec, r = S.sky(F.col("x"), F.col("y"), F.col("z"))
    return c.select("id", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"), F.round(r, 6).alias("dist"))


@query("p7_box_shift", "select id, x - (700::double - 16/2) as x, y + (700::double - 16/2) as y from fx_tracers_box")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "fx_tracers_box").select("id", S.box_shifted(F.col("x"), LENGTH, 700.0, back=True).alias("x"), S.box_shifted(F.col("y"), LENGTH, 700.0).alias("y"))


@query(
    "p8_weights",
    "select id, weight_fkp*weight_systot*(weight_noz+weight_cp-1) as w1, weight_fkp*weight_systot*weight_cp*weight_noz as w2, weight_fkp*(weight_systot*weight_cp) as w3, weight_systot*(weight_noz+weight_cp-1) as s1 from fx_sky",
)
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    sky = load(spark, sf_dir, "fx_sky").withColumn("weight_all_nofkp", F.col("weight_systot") * F.col("weight_cp"))
    return sky.select("id", S.tracer_weight(1).alias("w1"), S.tracer_weight(2).alias("w2"), S.tracer_weight(3).alias("w3"), S.tracer_weight(1, fkp=False).alias("s1"))


@query(
    "p9_periodic_wrap",
    "with s as (select id, x+x-8 as u from fx_tracers_box) select id, case when u > 16 then u-16 when u < 0 then u+16 else u end as open_wrap, case when u >= 16 then u-16 when u < 0 then u+16 else u end as closed_wrap, u*3 - 16*floor(u*3/16) as modulo from s",
)
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("x") + F.col("x") - 8
    return load(spark, sf_dir, "fx_tracers_box").select("id", S.wrapped(u, LENGTH).alias("open_wrap"), S.wrapped(u, LENGTH, True).alias("closed_wrap"), S.periodic(u * 3, LENGTH).alias("modulo"))


@query("p10_voxel_corner", "select cast(v as bigint) as vox, cast(v//256 as double)*0.5::double as x, cast((v%256)//16 as double)*0.5::double as y, cast(v%16 as double)*0.5::double as z from range(4096) t(v)")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = S.voxel_corner(F.col("vox"), N, 8.0)
    return M.all_voxels(spark, N).select("vox", x.alias("x"), y.alias("y"), z.alias("z"))


_DERIVED = "with o as (select o_orderkey as id, 1 + cast(o_orderkey % 97 as double)/8 as v, cast(o_orderkey % 13 as double)/16 - 0.5::double as d from orders)"


@query(
    "p11_p16_derived_quantities",
    f"{_DERIVED}, r as (select *, power(3*v/(4*pi()), 1.0::double/3) as radius from o) select id, round(radius, 9) as radius, round(d*power(radius, 1.2::double), 9) as lambda_v, round(d*power(radius, 1.6::double), 9) as lambda_c, "
    "round(degrees(radius/100), 9) as theta, round(exp(-5.12::double*(v-1)-0.8::double*power(v-1, 2.8::double)), 9) as prob_v, round(1.077::double/(power(v-1, 1.82::double)+0.077::double*power(v, 4.41::double)), 9) as prob_c, round(v+ln((1.718281828459045::double*v+14)/14), 9) as halo_key, round(1/v, 12) as inverted from r",
)
def p11_p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (1 + (F.col("o_orderkey") % 97).cast("double") / 8).alias("v"), ((F.col("o_orderkey") % 13).cast("double") / 16 - 0.5).alias("d"))
    v, d, r = F.col("v"), F.col("d"), F.col("radius")
    out = o.withColumn("radius", S.effective_radius(v)).select(
        "id", "radius", S.structure_parameter(d, r).alias("lambda_v"), S.structure_parameter(d, r, True).alias("lambda_c"), S.effective_angle(r, F.lit(100.0)).alias("theta"),
        S.significance(v).alias("prob_v"), S.significance(v, True).alias("prob_c"), S.halo_order(v, v, F.lit(14.0)).alias("halo_key"), F.round(S.inverted(v), 12).alias("inverted"),
    )
    return rounded(out, "radius", "lambda_v", "lambda_c", "theta", "prob_v", "prob_c", "halo_key", digits=9)


@query(
    "p17_mesh_sizing",
    "with n as (select cast(count(*) as double)/4096 as nbar from fx_tracers_box) select cast(floor(16/(0.5::double*power(4*pi()*nbar/3, -1.0::double/3))) as bigint) as cells, round(power(nbar, -1.0::double/3), 9) as smoothing from n",
)
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = load(spark, sf_dir, "fx_tracers_box").count()
    cells, smoothing = S.mesh_sizing(count / LENGTH**3, LENGTH)
    return spark.createDataFrame([(cells, round(smoothing, 9))], "cells long, smoothing double")


@query(
    "p18_volume_reweighting",
    "select id, case when id % 10 = 0 then v else v*3*f/w*c end as volume from (select id, 1+weight_fkp as v, weight_cp as f, weight_noz as w, comp as c from fx_sky) t",
)
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    sky = load(spark, sf_dir, "fx_sky")
    return sky.select("id", C.reweighted_volume(1 + F.col("weight_fkp"), F.col("id") % 10 == 0, 3.0, F.col("weight_cp"), F.col("weight_noz"), F.col("comp")).alias("volume"))


@query("f1_survey_cut", "select * from fx_sky where veto = 1 and redshift > 0.4::double and redshift < 0.73::double")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.survey_cut(load(spark, sf_dir, "fx_sky"), 0.4, 0.73)


@query("f2_f4_weighted_rows", "select id, weight_systot from fx_sky where veto = 1 and weight_systot > 0")
def f2_f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.weighted_only(load(spark, sf_dir, "fx_sky").where("veto = 1")).select("id", "weight_systot")


_TRIM = "select id, redshift from fx_sky where (select count(*) from fx_sky where redshift < {0} or redshift > {1}) = 0 or (redshift > {0} and redshift < {1})"


@query("f5_redshift_trim", _TRIM.format("0.43::double", "0.7::double"))
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.redshift_trim(load(spark, sf_dir, "fx_sky"), 0.43, 0.7).select("id", "redshift")


@query("f5_redshift_trim_nothing_outside", _TRIM.format("0.375::double", "0.9::double"))
def f5_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.redshift_trim(load(spark, sf_dir, "fx_sky"), 0.375, 0.9).select("id", "redshift")


@query("f13_border_particles", "with p as (select id, id % 5 = 0 as is_mock from fx_dens), a as (select src, count(*) as n, max(case when b.is_mock then 1 else 0 end) as m from fx_edges join p b on b.id = dst group by src) select p.id, coalesce(a.n, 0) as n_adj, (coalesce(a.m, 0) = 1 or coalesce(a.n, 0) < 4) as is_edge from p left join a on a.src = p.id")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "fx_dens").select("id", (F.col("id") % 5 == 0).alias("is_mock"))
    return C.border_flags(load(spark, sf_dir, "fx_edges"), p).select("id", "n_adj", "is_edge")


@query("f14_volume_guard", "select o_orderkey as id, case when v < 1e-30 or v > 1e30 then 1 else v end as volume from (select o_orderkey, case when o_orderkey % 7 = 0 then 0::double when o_orderkey % 11 = 0 then 1e31::double else cast(o_orderkey as double)/8 end as v from orders) t")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.when(k % 7 == 0, F.lit(0.0)).when(k % 11 == 0, F.lit(1e31)).otherwise(k.cast("double") / 8)
    return load(spark, sf_dir, "orders").select(k.alias("id"), C.guarded_volume(v).alias("volume"))


_CIC = """cic as (select cast(((ix+i)%16)*256+((iy+j)%16)*16+((iz+k)%16) as bigint) as vox, sum((case when i=1 then x-ix else 1-(x-ix) end)*(case when j=1 then y-iy else 1-(y-iy) end)*(case when k=1 then z-iz else 1-(z-iz) end)) as rho
from (select *, floor(x) ix, floor(y) iy, floor(z) iz from fx_tracers_box) c cross join (select a.i as i, b.i as j, c.i as k from (values (0),(1)) a(i), (values (0),(1)) b(i), (values (0),(1)) c(i)) o group by 1)"""


@query("g1_cloud_in_cell", f"with {_CIC} select * from cic")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.deposit(load(spark, sf_dir, "fx_tracers_box"), N, LENGTH)


@query("g2_extents", "select min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z from fx_tracers_box")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extents(load(spark, sf_dir, "fx_tracers_box"))


@query("g3_weight_sums", "with g as (select sum(weight_fkp*weight_systot*(weight_noz+weight_cp-1)) as g from fx_sky), r as (select sum(weight_fkp) as r from fx_randoms_sky) select round(g, 6) as sum_gal, round(r, 6) as sum_ran, round(g/r, 9) as alpha, round(0.01::double*r/4096, 9) as ran_min from g, r")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = C.mean_weights(load(spark, sf_dir, "fx_sky"), load(spark, sf_dir, "fx_randoms_sky"), S.tracer_weight(1), F.col("weight_fkp"), N**3)
    return rounded(rounded(sums, "sum_gal", "sum_ran"), "alpha", "ran_min", digits=9)


@query(
    "g4_radial_selection",
    "with e as (select i, power(0.5::double + i*(3.375::double-0.5::double)/15, 1.0::double/3) as low, power(0.5::double+(i+1)*(3.375::double-0.5::double)/15, 1.0::double/3) as high from range(15) t(i)), "
    "d as (select redshift+0.5::double as r from fx_sky) select cast(i as int) as bin, (select count(*) from d where r >= low and (r < high or (i = 14 and r = high))) as n, round((select count(*) from d where r >= low and (r < high or (i = 14 and r = high)))/(0.25::double*4*pi()/3*(power(high, 3)-power(low, 3)))/200, 9) as f from e",
)
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = (3.375 - 0.5) / 15
    edges = [(0.5 + i * step) ** (1.0 / 3) for i in range(16)]
    counts = C.radial_counts(load(spark, sf_dir, "fx_sky").select((F.col("redshift") + 0.5).alias("r")), "r", edges)
    return C.selection_function(counts, 200.0, 0.25).select("bin", "n", F.round("f", 9).alias("f"))


@query("g7_filled_cells", f"with {_CIC} select count(*) filter (where rho > 0) as filled from cic")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.filled_cells(M.deposit(load(spark, sf_dir, "fx_tracers_box"), N, LENGTH))


@query(
    "j1_gather",
    "with s as (select id, x, y, z, floor(x) ix, floor(y) iy, floor(z) iz from fx_tracers_box), o as (select a.i as i, b.i as j, c.i as k from (values (0),(1)) a(i), (values (0),(1)) b(i), (values (0),(1)) c(i)) "
    "select id, sum((case when i=1 then x-ix else 1-(x-ix) end)*(case when j=1 then y-iy else 1-(y-iy) end)*(case when k=1 then z-iz else 1-(z-iz) end)*cast((cast(((ix+i)%16)*256+((iy+j)%16)*16+((iz+k)%16) as bigint)*37) % 101 as double)) as a from s cross join o group by id",
)
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = M.all_voxels(spark, N).select("vox", ((F.col("vox") * 37) % 101).cast("double").alias("a"))
    return M.gather(load(spark, sf_dir, "fx_tracers_box"), field, ["a"], N, LENGTH)


@query("m5_m7_box_density", f"with {_CIC} select vox, rho*4096/(select count(*) from fx_tracers_box)-1 as delta, rho*4096/(select count(*) from fx_tracers_box) as density from cic")
def m5_m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "fx_tracers_box")
    total = float(points.count())
    return M.deposit(points, N, LENGTH).select("vox", M.contrast_box(F.col("rho"), N, total).alias("delta"), M.density_box(F.col("rho"), N, total).alias("density"))


_SURVEY = "s as (select cast(l_orderkey % 512 as bigint) as vox, sum(cast(l_quantity as double)) as g, cast(count(*) as double) as r from lineitem group by 1)"


@query("m6_f12_survey_contrast", f"with {_SURVEY} select vox, case when r > 40 then round(g/(25*r)-1, 9) else 0 end as delta, case when r > 40 then round(g/(25*r), 9) else 0.9e30::double end as density, r <= 40 as masked from s")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 512).cast("long").alias("vox")).agg(F.sum(F.col("l_quantity").cast("double")).alias("g"), F.count("*").cast("double").alias("r"))
    return s.select("vox", F.round(M.contrast_survey(F.col("g"), F.col("r"), 25.0, 40.0), 9).alias("delta"), F.round(M.density_survey(F.col("g"), F.col("r"), 25.0, 40.0), 9).alias("density"), (F.col("r") <= 40).alias("masked"))


_WATER = f"""{_CIC}, full_grid as (select cast(range as bigint) as vox, coalesce(rho, 0) as rho from range(4096) left join cic on vox = range),
g as (select * from (select vox as id, cast(rho as float)::double as dens from full_grid) where dens < 0.9e30),
faces as (select * from (values (0,0,0,1),(1,0,0,-1),(2,0,1,0),(3,0,-1,0),(4,1,0,0),(5,-1,0,0)) f(ord,a,b,c)),
e as (select g.id as src, ord, g.dens as d, cast(((g.id//256+a+16)%16)*256+(((g.id//16)%16+b+16)%16)*16+((g.id%16+c+16)%16) as bigint) as dst from g cross join faces),
v as (select e.src, e.dst, e.ord, e.d, n.dens as dn from e join g n on n.id = e.dst),
j as (select g.id, coalesce(m.nxt, g.id) as nxt from g left join (select src, arg_min(dst, {{'a': dn, 'b': ord}}) as nxt from v where dn < d group by src) m on m.src = g.id),
walk as (select id, nxt from j union select w.id, j.nxt from walk w join j on j.id = w.nxt where j.nxt <> w.nxt),
rt as (select w.id, w.nxt as root from walk w join j on j.id = w.nxt and j.nxt = w.nxt),
zn as (select rt.id, rt.root, cast(z.zone as bigint) as zone from rt join (select root, row_number() over (order by root) - 1 as zone from (select distinct root from rt)) z on z.root = rt.root),
sd as (select a.zone as h, b.zone as h2, min(greatest(v.d, v.dn)) as slv from v join zn a on a.id = v.src join zn b on b.id = v.dst where a.zone <> b.zone group by 1, 2),
tb as (select zn.zone as h, min(zn.root) as core, max(case when g.id = zn.root then g.dens end) as core_dens, count(*) as np from zn join g on g.id = zn.id group by 1)"""


def _basins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, V.Basins]:
    rho = kept(M.dense(M.deposit(load(spark, sf_dir, "fx_tracers_box"), N, LENGTH), N))
    return rho, V.watershed(rho, N)


@query("z1_z2_descent", f"with recursive {_WATER} select id, nxt from j")
def z1_z2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rho = M.dense(M.deposit(load(spark, sf_dir, "fx_tracers_box"), N, LENGTH), N)
    cells = rho.select(F.col("vox").alias("id"), F.col("rho").cast("float").cast("double").alias("dens"))
    valued = G.grid_edges(cells.select(F.col("id").alias("vox"), F.col("dens").alias("rho")), N)
    return G.jumpers(cells, valued)


@query("z3_zones", f"with recursive {_WATER} select id, root, zone from zn")
def z3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _basins(spark, sf_dir)[1].cells.select("id", "root", "zone")


@query("z4_g11_saddles", f"with recursive {_WATER} select h, h2, slv from sd")
def z4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _basins(spark, sf_dir)[1].links


@query("z5_direct_links", f"with recursive {_WATER} select tb.h, coalesce(min(slv), (select max(dens) from g)) as leak, round(case when core_dens = 0 then 'infinity'::double else coalesce(min(slv), (select max(dens) from g))/core_dens end, 9) as ratio from tb left join sd on sd.h = tb.h group by tb.h, core_dens")
def z5(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _basins(spark, sf_dir)[1]
    return rounded(G.direct_links(b.table, b.links, b.max_dens), "ratio", digits=9)


@query("g8_g12_zone_table", f"with recursive {_WATER} select h, core, core_dens, np, cast(np as double) as vol from tb")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _basins(spark, sf_dir)[1].table.select("h", "core", "core_dens", "np", "vol")


@query("g12_density_range", f"with {_CIC} select min(rho) as min_dens, max(rho) as max_dens from cic")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.density_range(M.deposit(load(spark, sf_dir, "fx_tracers_box"), N, LENGTH).select(F.col("vox").alias("id"), F.col("rho").alias("dens")))


def _voxel_sql(clusters: bool) -> str:
    rho = "rho*4096/(select count(*) from fx_tracers_box)"
    dens = f"case when rho = 0 then 0.9e30 else cast(1 as double)/({rho}) end" if clusters else rho
    water = _WATER.replace("cast(rho as float)::double as dens", f"cast({dens} as float)::double as dens")
    sign, power_, w = (">", "1.6::double", "rho") if clusters else ("<", "1.2::double", "1/greatest(rho, 1e-12::double)")
    return f"""with recursive {water}, dn as (select vox as id, cast(rho*4096/(select count(*) from fx_tracers_box) as float)::double as rho from full_grid),
lk as (select tb.h, case when core_dens = 0 then 'infinity'::double else coalesce(min(slv), (select max(dens) from g))/core_dens end as ratio from tb left join sd on sd.h = tb.h group by tb.h, core_dens),
ed as (select distinct zn.zone as h from zn join (select src, count(*) as n from v group by src) k on k.src = zn.id where k.n < 6),
pk as (select tb.h, tb.np, dn.rho as extreme from tb join dn on dn.id = tb.core where dn.rho {sign} 1 and tb.h not in (select h from ed)),
mb as (select zn.zone as h, avg(rho) as mean, sum(cast(zn.id//256 as double)*({w}))/sum({w}) as x, sum(((zn.id//16)%16)*({w}))/sum({w}) as y, sum((zn.id%16)*({w}))/sum({w}) as z from zn join dn on dn.id = zn.id group by 1)
select pk.h as id, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(power(3*np/(4*pi()), 1.0::double/3), 6) as radius, round(extreme-1, 6) as extreme, round(mean-1, 6) as mean_contrast,
round((mean-1)*power(power(3*np/(4*pi()), 1.0::double/3), {power_}), 6) as lambda, round(ratio, 6) as ratio from pk join mb on mb.h = pk.h join lk on lk.h = pk.h"""


@query("z14_voxel_voids", _voxel_sql(False))
def z14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.find_voids(load(spark, sf_dir, "fx_tracers_box"), N, LENGTH), "x", "y", "z", "radius", "extreme", "mean_contrast", "lambda", "ratio")


@query("z15_voxel_clusters", _voxel_sql(True))
def z15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.find_voids(load(spark, sf_dir, "fx_tracers_box"), N, LENGTH, clusters=True), "x", "y", "z", "radius", "extreme", "mean_contrast", "lambda", "ratio")


@query("s1_numbered_rows", "select l_orderkey, l_linenumber, cast(row_number() over (order by l_orderkey, l_linenumber)-1 as bigint) as particle from (select distinct l_orderkey, l_linenumber from lineitem) t")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.numbered(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", "particle")


@query("s2_union", "select 'galaxy' as kind, id as x, ra, weight_fkp as weight from fx_sky union all select 'buffer', id, ra, null from fx_randoms_sky union all select 'guard', id, null, null from fx_particles_vel")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = {c: F.col("id").cast("double") for c in "xyz"}
    tracers = load(spark, sf_dir, "fx_sky").withColumns(place | {"weight": F.col("weight_fkp")})
    randoms, points = load(spark, sf_dir, "fx_randoms_sky").withColumns(place), load(spark, sf_dir, "fx_particles_vel").withColumns(place)
    return B.standard(tracers, randoms, points).select("kind", F.col("x").cast("long").alias("x"), "ra", "weight")


@query("s4_adjacency", "select src, count(distinct dst) as n, min(dst) as first_dst, max(dst) as last_dst from fx_edges group by src")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = G.adjacency_lists(load(spark, sf_dir, "fx_edges"))
    return lists.select("src", F.size("adj").cast("long").alias("n"), F.col("adj")[0].alias("first_dst"), F.element_at("adj", -1).alias("last_dst"))


@query("t4_top_values", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 50)


import latticeflow.registry_graphs  # noqa: E402,F401  registers the rest
import latticeflow.registry_survey  # noqa: E402,F401
