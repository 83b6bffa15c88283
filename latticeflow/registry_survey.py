"""Queries in survey coordinates: cuts, mocks, selection tables, loaded buffers and shifted randoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.fixtures import load
from latticeflow.functions.cosmology import Cosmology
from latticeflow.functions.healpix import pixel_of
from latticeflow.operators import buffers as B
from latticeflow.operators import catalog as C
from latticeflow.operators import mesh as M
from latticeflow.plans import reconstruction as R
from latticeflow.plans import voxel as V
from latticeflow.operators.stage import kept, shared_path
from latticeflow.registry import _KNOTS, _WATER, LENGTH, N, _sky_xyz, query, rounded
from latticeflow.registry_graphs import _PIX
from latticeflow.sources import files


@query("f3_veto_cut", "select id, redshift from fx_sky where veto = 1")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unvetoed(load(spark, sf_dir, "fx_sky")).select("id", "redshift")


@query("io15_selection_table", "select distinct redshift as z, cast(c_bin as double)/7 as f from (select redshift, id % 16 as c_bin from fx_sky)")
def io15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "fx_sky").select(F.col("redshift").alias("z"), ((F.col("id") % 16).cast("double") / 7).alias("f")).distinct()
    return files.selection_table(files.selection_lines(rows))


_MOCKS = "select ra, dec, redshift, comp as c3, cast(1 as double)/8 + weight_fkp as c4, veto as c5, veto as c6, id from fx_sky"


@query(
    "io4_special_mocks",
    f"with m as ({_MOCKS}), s as (select *, sin(radians(dec)) as zz, ra/90 as tt from m), p as (select *, {_PIX} as pix from s) select round(ra, 9) as ra, round(dec, 9) as dec, redshift, 1/(10000*c4) as weight_fkp, c6 as veto, cast(pix % 8 as double)/8 as comp, cast(1 as double) as weight_cp from p",
)
def io4(spark: SparkSession, sf_dir: str) -> DataFrame:
    sky = load(spark, sf_dir, "fx_sky")
    rows = sky.select(F.col("ra").alias("c0"), F.col("dec").alias("c1"), F.col("redshift").alias("c2"), F.col("comp").alias("c3"), (F.lit(0.125) + F.col("weight_fkp")).alias("c4"), F.col("veto").alias("c5"), F.col("veto").alias("c6"))
    skymap = spark.range(3072).select(F.col("id").alias("pix"), ((F.col("id") % 8).cast("double") / 8).alias("val"))
    out = files.special_mocks(rows, False, skymap, 16)
    return rounded(out, "ra", "dec", digits=9).select("ra", "dec", "redshift", "weight_fkp", "veto", "comp", "weight_cp")


@query(
    "io19_loaded_buffers",
    "select 'galaxy' as kind, count(*) as n, min(ra) as low, max(redshift) as high from fx_sky union all select 'buffer', count(*), min(ra), cast(-1 as double) from fx_randoms_sky",
)
def io19(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = {c: F.lit(0.0) for c in "xyz"}
    tracers = load(spark, sf_dir, "fx_sky").withColumns(place | {"weight": F.col("weight_fkp")})
    rows = B.standard(tracers, load(spark, sf_dir, "fx_randoms_sky").withColumns(place), load(spark, sf_dir, "fx_tracers_box"))
    loaded = B.without_guards(B.of_sentinels(B.sentinels(rows)))
    return loaded.groupBy("kind").agg(F.count("*").alias("n"), F.min("ra").alias("low"), F.max("redshift").alias("high"))


_AT = "(select *, floor(x) ix, floor(y) iy, floor(z) iz from fx_particles_vel where x*x+y*y+z*z > 0) c cross join (select a.i as i, b.i as j, c.i as k from (values (0),(1)) a(i), (values (0),(1)) b(i), (values (0),(1)) c(i)) o"
_SHARE = "(case when i=1 then x-ix else 1-(x-ix) end)*(case when j=1 then y-iy else 1-(y-iy) end)*(case when k=1 then z-iz else 1-(z-iz) end)"
_VOX = "cast(((ix+i)%16)*256+((iy+j)%16)*16+((iz+k)%16) as bigint)"


@query(
    "m11_shifted_randoms",
    f"with s as (select id, x, y, z, {_VOX} as vox, {_SHARE} as share from {_AT}), g as (select id, max(x) as x, max(y) as y, max(z) as z, sum(share*cast(vox*37%101 as double)/64) as px, sum(share*cast(vox*41%103 as double)/64) as py, sum(share*cast(vox*43%107 as double)/64) as pz from s group by id), "
    "r as (select *, sqrt(x*x+y*y+z*z) as r from g) select id, " + ", ".join(f"round({c} + 0.75::double*(px*x+py*y+pz*z)/r*{c}/r, 6) as new{c}" for c in "xyz") + " from r",
)
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "fx_particles_vel").where("x*x + y*y + z*z > 0").select("id", "x", "y", "z")
    psi = M.all_voxels(spark, N).select("vox", *((((F.col("vox") * a) % b).cast("double") / 64).alias(f"psi_{c}") for c, a, b in (("x", 37, 101), ("y", 41, 103), ("z", 43, 107))))
    return rounded(R.shifted_randoms(points, psi, R.Mesh(N, LENGTH), 0.75).select("id", "newx", "newy", "newz"), "newx", "newy", "newz")


@query("io17_randoms_export", "select id, round(ra + 0.0000001::double, 6) as ra, round(dec + 0.0000001::double, 6) as dec, round(redshift + 0.0000001::double, 6) as redshift, weight_fkp from fx_randoms_sky")
def io17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sky_xyz(spark, sf_dir, "fx_randoms_sky").withColumnsRenamed({c: f"new{c}" for c in "xyz"})
    out = R.export_positions(rows, True, Cosmology(0.31), keep=("id",), randoms=True)
    return rounded(out.withColumns({n: F.col(n) + 1e-7 for n in ("ra", "dec", "redshift")}), "ra", "dec", "redshift")


@query("f11_edge_density", "select id, case when id % 5 = 0 then 0.9e30::double else dens end as dens from fx_dens")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "fx_dens").select("id", C.edge_density(F.col("dens"), F.col("id") % 5 == 0).alias("dens"))


_SEG = "seg as (select z as z0, r as r0, lead(z) over (order by i) as z1, lead(r) over (order by i) as r1 from tab)"


@query(
    "f8_catalogue_on_sky",
    f"with {_KNOTS}, {_SEG}, m as (select id, x+692 as x, y+692 as y, z+692 as z from fx_particles_vel), d as (select *, sqrt(x*x+y*y+z*z) as dist from m), s as (select *, z0 + (dist-r0)*(z1-z0)/(r1-r0) as redshift from d join seg on dist >= r0 and dist < r1) "
    "select id, round(degrees(atan2(y, x)), 6) as ra, round(90-degrees(acos(z/dist)), 6) as dec, round(redshift, 6) as redshift, round(degrees(2/dist), 6) as theta from s where redshift > 0.452::double and redshift < 0.457::double",
)
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "fx_particles_vel").select("id", "x", "y", "z", F.lit(2.0).alias("radius"))
    out = V.on_sky(rows, Cosmology(0.31), (700.0, 700.0, 700.0), LENGTH, 0.452, 0.457)
    return rounded(out.select("id", "ra", "dec", "redshift", "theta"), "ra", "dec", "redshift", "theta")


def _cic18(view: str, name: str, weight: str = "1") -> str:
    """Weights dealt to a grid of 18 cells a side that leaves a cell free around the box."""
    return (
        f"{name} as (select cast((ix+1+i)*324+(iy+1+j)*18+(iz+1+k) as bigint) as vox, sum((case when i=1 then x-ix else 1-(x-ix) end)*(case when j=1 then y-iy else 1-(y-iy) end)*(case when k=1 then z-iz else 1-(z-iz) end)*{weight}) as rho "
        f"from (select id, x, y, z, floor(x) ix, floor(y) iy, floor(z) iz from {view}) c cross join (select a.i as i, b.i as j, c.i as k from (values (0),(1)) a(i), (values (0),(1)) b(i), (values (0),(1)) c(i)) o group by 1)"
    )


def _survey_water() -> str:
    start = _WATER.index("g as (select * from (select vox as id")
    flood = _WATER[start:].replace("256", "324").replace("4096", "5832").replace("16", "18")
    grids = f"{_cic18('fx_particles_vel', 'tr', '(0.5::double + (id % 3)*0.25::double)')}, {_cic18('fx_particles_vel', 'rd')}"
    ratio = "full_grid as (select cast(range as bigint) as vox, case when coalesce(r.rho, 0) > 1 then coalesce(t.rho, 0)/(0.75::double*r.rho) else 0.9e30::double end as rho, coalesce(r.rho, 0) <= 1 as masked from range(5832) left join tr t on t.vox = range left join rd r on r.vox = range)"
    return f"{grids}, {ratio}, {flood}"


@query(
    "z14_f6_f12_survey_voids",
    f"""with recursive {_survey_water()}, dn as (select vox as id, cast(rho as float)::double as rho from full_grid),
lk as (select tb.h, case when core_dens = 0 then 'infinity'::double else coalesce(min(slv), (select max(dens) from g))/core_dens end as ratio from tb left join sd on sd.h = tb.h group by tb.h, core_dens),
ed as (select distinct zn.zone as h from zn join (select src, count(*) as n from v group by src) k on k.src = zn.id where k.n < 6),
pk as (select tb.h, tb.np, dn.rho as extreme from tb join dn on dn.id = tb.core where dn.rho < 1 and tb.h not in (select h from ed) and tb.core not in (select vox from full_grid where masked)),
mb as (select zn.zone as h, avg(rho) as mean, sum(cast(zn.id//324 as double)*(1/greatest(rho, 1e-12::double)))/sum(1/greatest(rho, 1e-12::double)) as x from zn join dn on dn.id = zn.id group by 1)
select pk.h as id, round(x, 6) as x, round(power(3*np/(4*pi()), 1.0::double/3), 6) as radius, round(extreme-1, 6) as extreme, round(mean-1, 6) as mean_contrast, round(ratio, 6) as ratio from pk join mb on mb.h = pk.h join lk on lk.h = pk.h""",
)
def z14_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A survey whose tracers are its randoms with weights of their own."""
    randoms = load(spark, sf_dir, "fx_particles_vel").withColumn("w", F.lit(1.0))
    sums = spark.createDataFrame([(0.75, 1.0)], "alpha double, ran_min double")
    field = kept(V.survey_density(randoms.withColumn("w", 0.5 + (F.col("id") % 3) * 0.25), randoms, 18, 18.0, (-1.0, -1.0, -1.0), sums))
    basins = V.watershed(field.select("vox", "rho"), 18)
    rho = field.select(F.col("vox").alias("id"), F.col("rho").cast("float").cast("double").alias("rho"))
    found = V.catalogue(basins, rho, 18, 18.0, 1.0, masked=field.select("vox", "masked"))
    return rounded(found.select("id", "x", "radius", "extreme", "mean_contrast", "ratio"), "x", "radius", "extreme", "mean_contrast", "ratio")


@query("io3_text_matrix", "select cast(id as double) as id, x, y/3 as y, vx from fx_particles_vel")
def io3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "matrix")
    files.write_text_matrix(load(spark, sf_dir, "fx_particles_vel").withColumn("y", F.col("y") / 3), ["id", "x", "y", "vx"], path)
    return files.text_matrix(spark, path, ["id", "x", "y", "vx"])


@query("io5_sky_map", f"with s as (select sin(radians(dec)) as zz, ra/90 as tt from fx_sky) select cast({_PIX} as bigint) as pix, cast(count(*) as double) as val from s group by 1")
def io5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "map")
    pix = pixel_of(F.col("ra"), F.col("dec"), 16).alias("pix")
    files.write_skymap(load(spark, sf_dir, "fx_sky").groupBy(pix).agg(F.count("*").alias("val")), path)
    return files.skymap(spark, path)
