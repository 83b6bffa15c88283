"""Queries on graphs, spectra, tessellations, sky maps, halos and hulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.fixtures import lists, load
from latticeflow.functions import healpix as H
from latticeflow.functions import scalars as S
from latticeflow.functions.cosmology import Cosmology
from latticeflow.functions.selection import Selection
from latticeflow.operators import buffers as B
from latticeflow.operators import catalog as C
from latticeflow.operators import graph as G
from latticeflow.operators import halos
from latticeflow.operators import hulls as Q
from latticeflow.operators import mesh as M
from latticeflow.operators import tessellation as T
from latticeflow.operators.stage import kept
from latticeflow.plans import cells as P
from latticeflow.plans import reconstruction as R
from latticeflow.registry import _KNOTS, LENGTH, N, query, rounded
from latticeflow.sources.files import catalogue_lines, hierarchy_text

_DENS = """v as (select e.src, e.dst, e.dst as ord, a.dens as d, b.dens as dn from fx_edges e join fx_dens a on a.id = e.src join fx_dens b on b.id = e.dst),
j as (select n.id, coalesce(m.nxt, n.id) as nxt from fx_dens n left join (select src, arg_min(dst, {'a': dn, 'b': ord}) as nxt from v where dn < d group by src) m on m.src = n.id),
walk as (select id, nxt from j union select w.id, j.nxt from walk w join j on j.id = w.nxt where j.nxt <> w.nxt),
rt as (select w.id, w.nxt as root from walk w join j on j.id = w.nxt and j.nxt = w.nxt),
zn as (select rt.id, rt.root, cast(z.zone as bigint) as zone from rt join (select root, row_number() over (order by root) - 1 as zone from (select distinct root from rt)) z on z.root = rt.root),
sd as (select a.zone as h, b.zone as h2, min(greatest(v.d, v.dn)) as slv from v join zn a on a.id = v.src join zn b on b.id = v.dst where a.zone <> b.zone group by 1, 2),
tb as (select zn.zone as h, min(zn.root) as core, max(case when n.id = zn.root then n.dens end) as core_dens, count(*) as np, sum(n.dens/8) as vol from zn join fx_dens n on n.id = zn.id group by 1)"""


def _tree(spark: SparkSession, sf_dir: str) -> P.Hierarchy:
    return P.basins_of_lists(lists(spark, sf_dir), LENGTH, load(spark, sf_dir, "fx_tracers_box").count())


@query("fx_edges_radius_graph", "select src, dst from fx_edges")
def fx_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "fx_edges")


@query("z16_graph_zones", f"with recursive {_DENS} select id, root, zone from zn")
def z16_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).zoned


@query("z16_graph_saddles", f"with recursive {_DENS} select h, h2, slv from sd")
def z16_saddles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).links.select("h", "h2", "slv")


@query("z16_graph_zone_table", f"with recursive {_DENS} select h, core, core_dens, np, round(vol, 9) as vol from tb")
def z16_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_tree(spark, sf_dir).table.select("h", "core", "core_dens", "np", "vol"), "vol", digits=9)


_FIRST = f"""with recursive {_DENS},
lk as (select tb.h, tb.core_dens, coalesce(min(slv), (select max(dens) from fx_dens)) as leak, count(slv) as n from tb left join sd on sd.h = tb.h group by 1, 2),
reach as (select lk.h, sd.h2 as z from lk join sd on sd.h = lk.h and sd.slv <= lk.leak union select r.h, sd.h2 from reach r join lk on lk.h = r.h join sd on sd.h = r.z and sd.slv <= lk.leak where sd.h2 <> r.h),
beat as (select r.h, min(t.core_dens) as deepest, count(*) as zones from reach r join tb t on t.h = r.z group by 1)"""


@query("z6_flood_first_step", _FIRST + " select lk.h, round(lk.leak/lk.core_dens, 9) as ratio, case when lk.n = 0 or beat.deepest < lk.core_dens then 0 else beat.zones end as zones from lk left join beat on beat.h = lk.h")
def z6(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return t.groups.select("h", F.round(F.coalesce(F.expr("try_element_at(groups, 1).ratio"), F.col("final_ratio")), 9).alias("ratio"), F.coalesce(F.expr("size(try_element_at(groups, 1).zones)"), F.lit(0)).cast("long").alias("zones"))


@query("z6_z7_flood_hierarchy")
def z7(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return rounded(G.joined(t.table, t.groups), "vol_join", "contrast", digits=9)


@query(
    "z8_f9_void_list",
    _FIRST + " select lk.h, tb.core, tb.core_dens, tb.np, round(case when lk.leak/lk.core_dens > 1e20 then -1 else lk.leak/lk.core_dens end, 9) as dens_ratio from lk join tb on tb.h = lk.h where lk.leak/lk.core_dens >= 1 and tb.core_dens < 6 and tb.np >= 3",
)
def z8(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return rounded(G.void_list(t.table, t.groups, 6.0, 3), "dens_ratio", digits=9).select("h", "core", "core_dens", "np", "dens_ratio")


@query(
    "z9_merged_zones",
    f"with recursive {_DENS}, lim as (select h, core_dens from tb), "
    "rise as (select h, h as z, cast(0 as double) as m from lim union select r.h, sd.h2, greatest(r.m, sd.slv) from rise r join lim a on a.h = r.h join lim c on c.h = r.z join sd on sd.h = r.z where c.core_dens >= a.core_dens and greatest(r.m, sd.slv) < 2*a.core_dens), "
    "low as (select h, z, min(m) as m from rise group by 1, 2), stop as (select low.h, min(m) as m from low join lim a on a.h = low.h join lim c on c.h = low.z where c.core_dens < a.core_dens group by 1) "
    "select low.h, count(*) as n_zones from low left join stop on stop.h = low.h where low.m < coalesce(stop.m, 1e300) group by low.h",
)
def z9(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return G.merged_zones(t.groups, 2.0).select("h", F.size("zones").cast("long").alias("n_zones"))


_COMMON = """cand as (select core, n, dens from (select src as core, dst as n from fx_edges) e join fx_dens d on d.id = e.n),
one as (select core, arg_min(n, {'a': dens, 'b': n}) as a from cand group by core),
two as (select cand.core, cand.n, cand.dens from cand join one on one.core = cand.core join fx_edges e on e.src = one.a and e.dst = cand.n),
sec as (select core, arg_min(n, {'a': dens, 'b': n}) as b from two group by core),
tri as (select two.core, two.n, two.dens from two join sec on sec.core = two.core join fx_edges e on e.src = sec.b and e.dst = two.n),
thi as (select core, arg_min(n, {'a': dens, 'b': n}) as c from tri group by core)"""


@query("j6_s3_common_neighbours", f"with {_COMMON} select n.id as core, coalesce(one.a, -1) as a, coalesce(sec.b, -1) as b, coalesce(thi.c, -1) as c from fx_dens n left join one on one.core = n.id left join sec on sec.core = n.id left join thi on thi.core = n.id")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = kept(load(spark, sf_dir, "fx_edges"))
    nodes = kept(load(spark, sf_dir, "fx_dens", edges))
    found = G.common_neighbours(edges, nodes, nodes.select(F.col("id").alias("core")))
    return found.select("core", *(F.coalesce(c, F.lit(-1)).alias(c) for c in "abc"))


def _image(c: str, n: str) -> str:
    return f"({n}.{c} + case when abs(k.{c}-{n}.{c}) > 8 then 16*sign(k.{c}-{n}.{c}) else 0 end - k.{c})"


_CENTRE = ", ".join(f"{_image(c, n)} as {n}{c}" for n in ("p", "q", "r") for c in "xyz")
_DET = "(px*(qy*rz-qz*ry)-py*(qx*rz-qz*rx)+pz*(qx*ry-qy*rx))"


@query(
    "z10_circumcentres",
    f"with {_COMMON}, v as (select k.id as h, thi.c is not null as ok, k.x as kx, k.y as ky, k.z as kz, {_CENTRE} from fx_dens n join fx_tracers_box k on k.id = n.id left join one on one.core = n.id left join sec on sec.core = n.id left join thi on thi.core = n.id "
    "left join fx_tracers_box p on p.id = one.a left join fx_tracers_box q on q.id = sec.b left join fx_tracers_box r on r.id = thi.c), "
    "b as (select *, (px*px+py*py+pz*pz)/2 as bp, (qx*qx+qy*qy+qz*qz)/2 as bq, (rx*rx+ry*ry+rz*rz)/2 as br from v), "
    f"c as (select h, ok, kx+(bp*(qy*rz-qz*ry)-py*(bq*rz-qz*br)+pz*(bq*ry-qy*br))/nullif({_DET}, 0) as x, ky+(px*(bq*rz-qz*br)-bp*(qx*rz-qz*rx)+pz*(qx*br-bq*rx))/nullif({_DET}, 0) as y, kz+(px*(qy*br-bq*ry)-py*(qx*br-bq*rx)+bp*(qx*ry-qy*rx))/nullif({_DET}, 0) as z from b) "
    "select h, round(case when ok then case when x < 0 or x > 16 then x-16*sign(x) else x end else 0 end, 5) as x, round(case when ok then case when y < 0 or y > 16 then y-16*sign(y) else y end else 0 end, 5) as y, "
    "round(case when ok then case when z < 0 or z > 16 then z-16*sign(z) else z end else 0 end, 5) as z, case when ok then 'ok' else 'missing' end as status from c",
)
def z10(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = kept(load(spark, sf_dir, "fx_edges"))
    nodes = kept(load(spark, sf_dir, "fx_dens", edges))
    voids = nodes.select(F.col("id").alias("h"), F.col("id").alias("core"))
    return rounded(P.circumcentres(voids, nodes, edges, load(spark, sf_dir, "fx_tracers_box"), LENGTH), "x", "y", "z", digits=5)


@query(
    "g13_g15_z12_barycentres",
    f"with recursive {_DENS}, m as (select zn.zone as h, k.x as kx, k.y as ky, k.z as kz, n.dens, n.dens/8 as w, "
    + ", ".join(f"p.{c} + case when abs(k.{c}-p.{c}) > 8 then 16*sign(k.{c}-p.{c}) else 0 end - k.{c} as d{c}" for c in "xyz")
    + " from zn join fx_dens n on n.id = zn.id join fx_tracers_box p on p.id = zn.id join fx_tracers_box k on k.id = zn.root), "
    "s as (select h, sum(w*dens)/sum(w) as mean, sum(w*dx)/sum(w)+max(kx) as x, sum(w*dy)/sum(w)+max(ky) as y, sum(w*dz)/sum(w)+max(kz) as z from m group by h) "
    "select h, " + ", ".join(f"round(case when {c} < 0 or {c} > 16 then {c}-16*sign({c}) else {c} end, 6) as {c}" for c in "xyz") + ", round(mean, 6) as mean from s",
)
def z12(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return rounded(P.centres(t, LENGTH), "x", "y", "z", "mean")


# ---- spectra -------------------------------------------------------------------------------------

_CIC8 = """grid as (select cast(((ix+i)%8)*64+((iy+j)%8)*8+((iz+k)%8) as bigint) as vox, sum((case when i=1 then u-ix else 1-(u-ix) end)*(case when j=1 then v-iy else 1-(v-iy) end)*(case when k=1 then w-iz else 1-(w-iz) end)) as re, cast(0 as double) as im
from (select x/2 as u, y/2 as v, z/2 as w, floor(x/2) ix, floor(y/2) iy, floor(z/2) iz from fx_tracers_box) c cross join (select a.i as i, b.i as j, c.i as k from (values (0),(1)) a(i), (values (0),(1)) b(i), (values (0),(1)) c(i)) o group by 1)"""


def _dft(source: str, name: str, inverse: bool = False) -> str:
    """Three chained transforms of eight cells along each axis."""
    out, last = [], source
    for k, stride in enumerate((64, 8, 1)):
        ang = f"2*pi()*(((g.vox//{stride})%8)*q.k)/8"
        sign = "+" if inverse else "-"
        other = "-" if inverse else "+"
        step = f"{name}{k}" if k < 2 else name
        scale = "/8" if inverse else ""
        out.append(
            f"{step} as (select g.vox - ((g.vox//{stride})%8)*{stride} + q.k*{stride} as vox, sum(g.re*cos({ang}) {other} g.im*sin({ang})){scale} as re, sum(g.im*cos({ang}) {sign} g.re*sin({ang})){scale} as im from {last} g cross join (select cast(range as bigint) as k from range(8)) q group by 1)"
        )
        last = step
    return ", ".join(out)


_K = ", ".join(f"(case when {i} < 4 then {i} else {i}-8 end)*2*pi()/16 as k{a}" for a, i in (("x", "(vox//64)"), ("y", "((vox//8)%8)"), ("z", "(vox%8)")))


def _grid8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dense(M.deposit(load(spark, sf_dir, "fx_tracers_box"), 8, LENGTH), 8)


@query("m1_fourier_transform", f"with {_CIC8}, {_dft('grid', 'f')} select vox, round(re, 5) + 0.0 as re, round(im, 5) + 0.0 as im from f")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.transformed(_grid8(spark, sf_dir).select("vox", F.col("rho").alias("re"), F.lit(0.0).alias("im")), 8)
    return f.select("vox", (F.round("re", 5) + 0.0).alias("re"), (F.round("im", 5) + 0.0).alias("im"))


@query("m2_spectral_smoothing", f"with {_CIC8}, {_dft('grid', 'f')}, w as (select *, {_K} from f), s as (select vox, re*exp(-0.5*(kx*kx+ky*ky+kz*kz)*4) as re, im*exp(-0.5*(kx*kx+ky*ky+kz*kz)*4) as im from w), {_dft('s', 'b', True)} select vox, round(re, 6) as rho from b")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.fourier_smoothed(_grid8(spark, sf_dir), R.Mesh(8, LENGTH), 2.0), "rho")


_PSI = f"with {_CIC8}, {_dft('grid', 'f')}, w as (select *, {_K} from f), d as (select vox, kx, ky, kz, case when kx*kx+ky*ky+kz*kz = 0 then 0 else exp(-0.5*(kx*kx+ky*ky+kz*kz)*4)*512/(select count(*) from fx_tracers_box)/(kx*kx+ky*ky+kz*kz) end as s, re, im from w), " + ", ".join(
    f"s{a} as (select vox, im*s*k{a}/2 as re, -re*s*k{a}/2 as im from d), {_dft(f's{a}', f'o{a}', True)}" for a in "xyz"
)


@query("m3_m4_displacements", _PSI + " select ox.vox, round(ox.re, 6)+0.0 as psi_x, round(oy.re, 6)+0.0 as psi_y, round(oz.re, 6)+0.0 as psi_z from ox join oy on oy.vox = ox.vox join oz on oz.vox = ox.vox")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "fx_tracers_box")
    psi = R.box_psi(points, R.Mesh(8, LENGTH), 2.0, 2.0, float(points.count()))
    return psi.select("vox", *((F.round(f"psi_{a}", 6) + 0.0).alias(f"psi_{a}") for a in "xyz"))


_KERNEL = "ker as (select cast(range as bigint)-4 as d, exp(-0.5*(range-4)*(range-4)) / (select sum(exp(-0.5*(range-4)*(range-4))) from range(9)) as w from range(9))"


def _blur(source: str, name: str) -> str:
    out, last = [], source
    for k, stride in enumerate((256, 16, 1)):
        step = f"{name}{k}" if k < 2 else name
        at = f"((g.vox//{stride})%16)"
        out.append(f"{step} as (select g.vox - {at}*{stride} + (({at}+d+16)%16)*{stride} as vox, sum(rho*w) as rho from {last} g cross join ker group by 1)")
        last = step
    return ", ".join(out)


_CIC16 = """cic as (select cast(((ix+i)%16)*256+((iy+j)%16)*16+((iz+k)%16) as bigint) as vox, sum((case when i=1 then x-ix else 1-(x-ix) end)*(case when j=1 then y-iy else 1-(y-iy) end)*(case when k=1 then z-iz else 1-(z-iz) end)) as rho
from (select *, floor(x) ix, floor(y) iy, floor(z) iz from fx_tracers_box) c cross join (select a.i as i, b.i as j, c.i as k from (values (0),(1)) a(i), (values (0),(1)) b(i), (values (0),(1)) c(i)) o group by 1)"""


@query("m8_gaussian_smoothing", f"with {_CIC16}, {_KERNEL}, {_blur('cic', 's')} select vox, round(rho, 9) as rho from s")
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = M.dense(M.deposit(load(spark, sf_dir, "fx_tracers_box"), N, LENGTH), N)
    return rounded(M.smoothed(grid, N, 1.0), "rho", digits=9)


@query("m9_m10_reconstruction")
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.reconstruct(load(spark, sf_dir, "fx_tracers_box"), R.Mesh(8, LENGTH), 2.0, rounds=2)
    return rounded(out.select("id", "newx", "newy", "newz"), "newx", "newy", "newz", digits=9)


def _survey(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, R.Mesh]:
    c = Cosmology(0.31)
    out = []
    for view in ("fx_sky", "fx_randoms_sky"):
        rows = load(spark, sf_dir, view).withColumn("dist", c.distance(F.col("redshift")))
        x, y, z = S.cartesian(F.col("ra"), F.col("dec"), F.col("dist"))
        out.append(rows.select("id", x.alias("x"), y.alias("y"), z.alias("z"), (S.tracer_weight(1) if view == "fx_sky" else F.col("weight_fkp")).alias("w")))
    ends = C.extents(out[1]).first().asDict()
    return out[0], out[1], R.survey_mesh(ends, 16, 50.0)


@query("m9_survey_reconstruction")
def m9_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracers, randoms, mesh = _survey(spark, sf_dir)
    sums = C.mean_weights(tracers, randoms, F.col("w"), F.col("w"), mesh.n**3).first()
    out = R.reconstruct(tracers, mesh, 30.0, rounds=1, randoms=randoms, alpha=sums["alpha"], ran_min=sums["ran_min"])
    return rounded(out.select("id", "newx", "newy", "newz"), "newx", "newy", "newz")


_SHARE8 = "(case when i=1 then u-ix else 1-(u-ix) end)*(case when j=1 then v-iy else 1-(v-iy) end)*(case when k=1 then h-iz else 1-(h-iz) end)"


@query(
    "m11_m12_full_shifts",
    _PSI
    + ", psi as (select ox.vox, ox.re as px, oy.re as py, oz.re as pz from ox join oy on oy.vox = ox.vox join oz on oz.vox = ox.vox), "
    + f"s as (select id, x, y, z, cast(((ix+i)%8)*64+((iy+j)%8)*8+((iz+k)%8) as bigint) as vox, {_SHARE8} as share from (select id, x, y, z, x/2 as u, y/2 as v, z/2 as h, floor(x/2) ix, floor(y/2) iy, floor(z/2) iz from fx_tracers_box) c "
    + "cross join (select a.i as i, b.i as j, c.i as k from (values (0),(1)) a(i), (values (0),(1)) b(i), (values (0),(1)) c(i)) o), "
    + "g as (select id, max(x) as x, max(y) as y, max(z) as z, sum(share*px) as px, sum(share*py) as py, sum(share*pz) as pz from s join psi on psi.vox = s.vox group by id) "
    + "select id, " + ", ".join(f"round(({c}+p{c}) - 16*floor(({c}+p{c})/16), 6) as new{c}" for c in "xyz") + " from g",
)
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "fx_tracers_box")
    mesh = R.Mesh(8, LENGTH)
    psi = R.box_psi(points, mesh, 2.0, 2.0, float(points.count()))
    out = R.fully_shifted(points.withColumns({f"new{a}": F.col(a) for a in "xyz"}), psi, mesh)
    return rounded(out.select("id", "newx", "newy", "newz"), "newx", "newy", "newz")


@query("g16_shift_summary", "with s as (select 'x' as axis, y-x as s from fx_tracers_box union all select 'y', z-y from fx_tracers_box union all select 'z', x-z from fx_tracers_box) select axis, round(stddev_pop(s), 9) as std, round(quantile_cont(s, 0.16), 9) as p16, round(quantile_cont(s, 0.84), 9) as p84, min(s) as least, max(s) as most from s group by axis")
def g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "fx_tracers_box")
    return rounded(R.shift_summary(p.withColumns({"newx": F.col("y"), "newy": F.col("z"), "newz": F.col("x")})), "std", "p16", "p84", digits=9)


_EDGES = "select max(x) as x1, min(x) as x0, max(y) as y1, min(y) as y0, max(z) as z1, min(z) as z0, count(*) as n from {}"
_XYZ = "select dist*cos(radians(dec))*cos(radians(ra)) as x, dist*cos(radians(dec))*sin(radians(ra)) as y, dist*sin(radians(dec)) as z from (select s.*, r0 + (r1-r0)*(redshift-z0)/(z1-z0) as dist from {} s join seg on redshift >= z0 and redshift < z1)"


@query(
    "m13_m14_survey_meshes",
    f"with {_KNOTS}, seg as (select z as z0, r as r0, lead(z) over (order by i) as z1, lead(r) over (order by i) as r1 from tab), r as ({_EDGES.format('(' + _XYZ.format('fx_randoms_sky') + ')')}), t as ({_EDGES.format('(' + _XYZ.format('fx_sky') + ')')}), "
    "p as (select *, greatest(x1-x0, y1-y0, z1-z0) + 100 as len from r), k as (select t.*, 5*pow(2, range) as pad, greatest(t.x1-t.x0, t.y1-t.y0, t.z1-t.z0) + 10*pow(2, range) as len, t.n/pow(p.len, 3) as nbar from t, p, range(24)), "
    "c as (select *, floor(len/(0.5::double*pow(4*pi()*nbar/3, -1.0::double/3))) as cells from k), b as (select * from c where cells = 0 or pad >= len/cells order by pad limit 1) "
    "select 'padded' as mesh, cast(16 as int) as n, round(len, 2) as length, round((x1+x0-len)/2, 2) as x0, round((y1+y0-len)/2, 2) as y0, round((z1+z0-len)/2, 2) as z0 from p union all select 'sized', cast(greatest(cells, 1) as int), round(len, 2), round(x0-pad, 2), round(y0-pad, 2), round(z0-pad, 2) from b",
)
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracers, _, mesh = _survey(spark, sf_dir)
    ends = C.extents(tracers).first().asDict()
    sized = R.padded_survey_mesh(ends, tracers.count() / mesh.length**3)
    return spark.createDataFrame([(name, m.n, round(m.length, 2), *(round(o, 2) for o in m.origin)) for name, m in (("padded", mesh), ("sized", sized))], "mesh string, n int, length double, x0 double, y0 double, z0 double")


# ---- sky ------------------------------------------------------------------------------------------

_PIX = """(case when abs(zz) <= 2.0::double/3 then
 (select 2*16*15 + (ir-1)*64 + ((jp+jm-16+(case when ir % 2 = 0 then 1 else 0 end)+1)//2 + 64) % 64 from (select jp, jm, 17+jp-jm as ir from (select cast(floor(16*(0.5::double+tt)-16*zz*0.75::double) as bigint) as jp, cast(floor(16*(0.5::double+tt)+16*zz*0.75::double) as bigint) as jm)))
 else (select case when zz > 0 then 2*ir*(ir-1) + cast(floor(tt*ir) as bigint) % (4*ir) else 3072 - 2*ir*(ir+1) + cast(floor(tt*ir) as bigint) % (4*ir) end from (select cast(floor((tt-floor(tt))*16*sqrt(3*(1-abs(zz)))) as bigint) + cast(floor((1-(tt-floor(tt)))*16*sqrt(3*(1-abs(zz)))) as bigint) + 1 as ir)) end)"""


@query("h1_pixel_of_direction", f"with s as (select id, sin(radians(dec)) as zz, ra/90 as tt from fx_sky) select id, cast({_PIX} as bigint) as pix from s")
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "fx_sky").select("id", H.pixel_of(F.col("ra"), F.col("dec"), 16).alias("pix"))


def _centre(n: int) -> str:
    """SQL of the centres of all pixels: ``(pix, zz, tt)`` with the sine of the latitude and the longitude in right angles."""
    cap, whole = 2 * n * (n - 1), 12 * n * n
    return f"""select pix, case when pix < {cap} then 1 - i*i/(3.0::double*{n * n}) when pix < {whole - cap} then (2*{n}-i)*2/(3.0::double*{n}) else -1 + i*i/(3.0::double*{n * n}) end as zz,
case when pix < {cap} then (j-0.5::double)/i when pix < {whole - cap} then (j - (1+(i+{n})%2)/2.0::double)/{n} else (j-0.5::double)/i end as tt
from (select *, case when pix < {cap} then pix+1-2*i*(i-1) when pix < {whole - cap} then (pix-{cap})%{4 * n}+1 else 4*i+1-({whole}-pix-2*i*(i-1)) end as j from
(select cast(range as bigint) as pix, cast(case when range < {cap} then floor((1+sqrt(1+2*range))/2) when range < {whole - cap} then (range-{cap})//{4 * n}+{n} else floor((1+sqrt(2*({whole}-range)-1))/2) end as bigint) as i from range({whole})))"""


@query("h2_h5_pixel_centres", f"select pix, round(tt*90, 6) as ra, round(degrees(asin(zz)), 6) as dec, cast(16 as int) as nside from ({_centre(16)})")
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra, dec = H.centre_of(F.col("pix"), 16)
    return spark.range(H.pixels(16)).select(F.col("id").alias("pix")).select("pix", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"), F.lit(H.side_of(3072)).alias("nside"))


def _mask(spark: SparkSession, sf_dir: str, nside: int = 16) -> DataFrame:
    return B.occupied(load(spark, sf_dir, "fx_sky"), nside).withColumn("val", F.lit(1.0))


@query("g5_g6_sky_fraction", f"with s as (select id, sin(radians(dec)) as zz, ra/90 as tt from fx_sky), p as (select distinct {_PIX} as pix from s) select cast(count(*) as double)/3072 as f_sky from p")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sky_fraction(_mask(spark, sf_dir), 16)


@query("j8_io4_completeness", f"with s as (select id, sin(radians(dec)) as zz, ra/90 as tt from fx_sky), p as (select id, {_PIX} as pix from s) select id, cast(pix % 8 as double)/8 as comp from p")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    skymap = spark.range(3072).select(F.col("id").alias("pix"), ((F.col("id") % 8).cast("double") / 8).alias("val"))
    return B.completeness(load(spark, sf_dir, "fx_sky"), skymap, 16).select("id", "comp")


@query("f17_tracers_in_mask", f"with s as (select id, sin(radians(dec)) as zz, ra/90 as tt from fx_sky), p as (select id, {_PIX} as pix from s) select id from p where pix % 3 = 0")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = spark.range(3072).where("id % 3 = 0").select(F.col("id").alias("pix"))
    return B.unmasked(load(spark, sf_dir, "fx_sky"), mask, 16).select("id")


@query("h3_pixel_neighbours")
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.with_neighbours(spark.range(H.pixels(16)).select(F.col("id").alias("pix")), 16)


def _pix(n: int) -> str:
    """:data:`_PIX` at another resolution (an even one)."""
    for old, new in (("2*16*15", f"{2 * n * (n - 1)}"), ("(ir-1)*64", f"(ir-1)*{4 * n}"), ("jp+jm-16+", f"jp+jm-{n}+"), ("//2 + 64) % 64", f"//2 + {4 * n}) % {4 * n}"), ("17+jp-jm", f"{n + 1}+jp-jm"), ("floor(16*(", f"floor({n}*("), ("-16*zz", f"-{n}*zz"), ("+16*zz", f"+{n}*zz"), ("3072", str(12 * n * n)), ("*16*sqrt", f"*{n}*sqrt")):
        sql = (sql if old != "2*16*15" else _PIX).replace(old, new)
    return sql


@query(
    "h4_regraded_map",
    f"with s as (select sin(radians(dec)) as zz, ra/90 as tt from fx_sky), p as (select distinct cast({_PIX} as bigint) as pix from s), c as ({_centre(16)}), d as (select c.* from c join p on p.pix = c.pix), f as ({_centre(32)}), "
    f"up as (select pix as fine, cast({_PIX} as bigint) as pix from f) select cast({_pix(8)} as bigint) as pix, count(*)/4.0::double as val from d group by 1 union all select up.fine, cast(1 as double) from up join p on p.pix = up.pix",
)
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.regraded(_mask(spark, sf_dir), 16, 8).unionByName(H.regraded(_mask(spark, sf_dir), 16, 32))


@query("h6_mask_boundary")
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.boundary(_mask(spark, sf_dir), 16)


@query("v8_v10_buffer_layers")
def v8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = kept(_mask(spark, sf_dir).select("pix"))
    f_sky = mask.count() / H.pixels(16)
    high, low = B.high_cap(1800.0, 1e-6, 10.0, f_sky), B.low_cap(1000.0, 1e-6, 10.0, f_sky)
    ring = kept(H.boundary(mask.withColumn("val", F.lit(1.0)), 16))
    side = B.edge_layer(low.low, high.high, 1e-6, 10.0, ring.count() / H.pixels(16))
    parts = [B.scattered(p, 16, layer, seed).withColumn("layer", F.lit(name)) for name, p, layer, seed in (("high", mask, high, 1), ("low", mask, low, 2), ("edge", ring, side, 3))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_GUARD = "cast(0.1 as double)+{i}.range*(cast(15.8 as double)/29)"


@query(
    "v11_j7_guards",
    "with g as (select cast(a.range*900+b.range*30+c.range as bigint) as id, " + ", ".join(f"{_GUARD.format(i=i)} as {c}" for i, c in zip("abc", "xyz")) + " from range(30) a, range(30) b, range(30) c), "
    "cell as (select *, cast(floor(x) as int) as i, cast(floor(y) as int) as j, cast(floor(z) as int) as k from fx_tracers_box), near as (select (i+a.range-1+16)%16 as i, (j+b.range-1+16)%16 as j, (k+c.range-1+16)%16 as k, x, y, z from cell, range(3) a, range(3) b, range(3) c), "
    "hit as (select distinct g.id from g join near p on p.i = cast(floor(g.x) as int) and p.j = cast(floor(g.y) as int) and p.k = cast(floor(g.z) as int) where "
    + "+".join(f"power(abs(g.{c}-p.{c}) - case when abs(g.{c}-p.{c}) > 8 then 16 else 0 end, 2)" for c in "xyz")
    + " <= power(cast(15.8 as double)/30, 2)) select g.id, round(g.x, 9) as x, round(g.y, 9) as y, round(g.z, 9) as z from g where g.id not in (select id from hit)",
)
def v11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.outer_guards(spark, load(spark, sf_dir, "fx_tracers_box"), 30, LENGTH), "x", "y", "z", digits=9)


# ---- tessellation ----------------------------------------------------------------------------------


@query("v1_v3_tessellation")
def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tessellate(load(spark, sf_dir, "fx_tracers_box"), LENGTH).select("id", F.round("volume", 6).alias("volume"), F.size("neighbours").alias("n_neighbours"))


@query("v6_isolated_tessellation")
def v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tessellate(load(spark, sf_dir, "fx_tracers_box"), LENGTH, periodic=False).select("id", F.round("volume", 6).alias("volume"), F.size("neighbours").alias("n_neighbours"))


@query("v5_g17_tessellation_checks", "select (select count(*) from fx_tracers_box) as n, cast(1 as double) as mean_volume")
def v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.checks(T.tessellate(load(spark, sf_dir, "fx_tracers_box"), LENGTH)).select("n", F.round("mean_volume", 6).alias("mean_volume"))


@query("j10_ghosts", "with o as (select range-1 as d from range(3)), c as (select p.id, p.x+16*a.d as x, p.y+16*b.d as y, p.z+16*c.d as z from fx_tracers_box p, o a, o b, o c), s as (select range as i from range(4)) "
       "select cast((sx.i*4+sy.i)*4+sz.i as bigint) as box, c.id, c.x, c.y, c.z from c, s sx, s sy, s sz where c.x between sx.i*4-1 and sx.i*4+5 and c.y between sy.i*4-1 and sy.i*4+5 and c.z between sz.i*4-1 and sz.i*4+5")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ghosts(load(spark, sf_dir, "fx_tracers_box"), LENGTH, 4, 1.0).select("box", "id", "x", "y", "z")


@query("z11_tessellation_voids")
def z11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.find_voids(load(spark, sf_dir, "fx_tracers_box"), LENGTH), "x", "y", "z", "radius", "extreme", "mean_contrast", "lambda", "ratio", digits=4)


@query("z13_tessellation_clusters")
def z13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.find_clusters(load(spark, sf_dir, "fx_tracers_box"), LENGTH), "x", "y", "z", "radius", "extreme", "mean_contrast", "lambda", "ratio", digits=4)


# ---- halos -----------------------------------------------------------------------------------------


@query("v7_f13_real_edges", "select src, dst from fx_edges where src % 5 <> 0 and dst % 5 <> 0")
def v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = load(spark, sf_dir, "fx_dens").select("id", (F.col("id") % 5 == 0).alias("is_mock"))
    return T.real_edges(load(spark, sf_dir, "fx_edges"), real)


@query("io9_symmetric_edges", "select src, dst from fx_edges")
def io9(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = load(spark, sf_dir, "fx_edges").where("src < dst")
    return T.symmetric(once)


@query("io12_single_precision", f"with {_CIC16} select vox, cast(cast(rho/3 as float) as double) as rho from cic")
def io12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.deposit(load(spark, sf_dir, "fx_tracers_box"), N, LENGTH).select("vox", (F.col("rho") / 3).cast("float").cast("double").alias("rho"))


@query("io14_catalogue_lines", "select cast(id as varchar) || ' ' || printf('%.4f', x + 0.00001) || ' ' || printf('%.4f', y + 0.00001) as line from fx_tracers_box")
def io14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "fx_tracers_box").select("id", (F.col("x") + 0.00001).alias("x"), (F.col("y") + 0.00001).alias("y"))
    return rows.select(catalogue_lines(rows, ["id", "x", "y"]).alias("line"))


@query("io13_hierarchy_lines")
def io13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy_text(_tree(spark, sf_dir).groups)


@query("io17_survey_export", "select id, round(ra + 0.0000001::double, 6) as ra, round(dec + 0.0000001::double, 6) as dec, round(redshift + 0.0000001::double, 6) as redshift, weight_systot, comp from fx_sky")
def io17(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Cosmology(0.31)
    rows = load(spark, sf_dir, "fx_sky").withColumn("dist", c.distance(F.col("redshift")))
    x, y, z = S.cartesian(F.col("ra"), F.col("dec"), F.col("dist"))
    out = R.export_positions(rows.withColumns({"newx": x, "newy": y, "newz": z}), True, c, keep=("id",))
    return rounded(out.withColumns({n: F.col(n) + 1e-7 for n in ("ra", "dec", "redshift")}), "ra", "dec", "redshift")


@query("p19_smooth_selection")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    sky = load(spark, sf_dir, "fx_sky")
    step = (3.375 - 0.5) / 15
    edges = [(0.5 + i * step) ** (1.0 / 3) for i in range(16)]
    counts = C.selection_function(C.radial_counts(sky.select((F.col("redshift") + 0.5).alias("r")), "r", edges), 200.0, 0.25).orderBy("bin").collect()
    ends = sky.agg(F.min("redshift").alias("low"), F.max("redshift").alias("high")).first()
    curve = Selection([(r["low"] + r["high"]) / 2 - 0.5 for r in counts], [r["f"] for r in counts], ends["low"], ends["high"])
    return sky.select("id", F.round(curve(F.col("redshift")), 9).alias("f"))


@query("g18_velocity_centroids", "select halo, count(*) as n, round(avg(vx), 9) as vx, round(avg(vy), 9) as vy, round(avg(vz), 9) as vz from fx_particles_vel group by halo")
def g18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(halos.velocity_centroids(load(spark, sf_dir, "fx_particles_vel")), "vx", "vy", "vz", digits=9)


@query("j11_pair_potential", "select a.id, round(sum(1/sqrt(power(a.x-b.x, 2)+power(a.y-b.y, 2)+power(a.z-b.z, 2))), 6) as potential from fx_particles_vel a join fx_particles_vel b on a.halo = b.halo and a.id <> b.id group by a.id")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(halos.pair_potential(load(spark, sf_dir, "fx_particles_vel")), "potential")


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "fx_particles_vel")
    first = p.groupBy("halo").agg(F.min("id").alias("core"))
    return halos.unbound_removed(p.join(first, "halo").withColumns({"central": F.lit(True), "is_core": F.col("id") == F.col("core")}).drop("core"), halos.Units(LENGTH, 4))


@query("b2_g19_bound_halos")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_bound(spark, sf_dir), "bound_total", "bound_least", "vx", "vy", "vz")


@query("b5_halos_by_bound_mass")
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return halos.by_bound_mass(_bound(spark, sf_dir)).select("halo", "n_bound", "n_total")


@query("b1_halo_candidates")
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return rounded(halos.candidates(t.table, t.groups), "prob", "key")


# ---- hulls -----------------------------------------------------------------------------------------


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "fx_tracers_box").withColumn("grp", F.pmod(F.floor(F.col("id") / 2), F.lit(50)))


@query("qh2_convex_hulls")
def qh2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.facets(_groups(spark, sf_dir), ["x", "y", "z"]).select("grp", "facet", F.array_join("vertices", " ").alias("vertices"), F.round("area", 9).alias("area"), F.array_join("neighbours", " ").alias("neighbours"))


@query(
    "qh2_extreme_points",
    "with p as (select id, (id//2) % 50 as grp, x, y from fx_tracers_box), e as (select distinct a.grp, a.id, atan2(b.y-a.y, b.x-a.x) as t from p a join p b on a.grp = b.grp and (a.x <> b.x or a.y <> b.y)), "
    "g as (select grp, id, coalesce(lead(t) over (partition by grp, id order by t) - t, 2*pi() - max(t) over (partition by grp, id) + min(t) over (partition by grp, id)) as gap from e) select distinct grp, id from g where gap > pi() + 1e-10",
)
def qh2_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.extreme_points_2d(_groups(spark, sf_dir)).select("grp", "id")


@query("qh3_delaunay")
def qh3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.simplices(_groups(spark, sf_dir), ["x", "y"]).select("grp", "simplex", F.array_join("vertices", " ").alias("vertices"))


@query("qh3_furthest_delaunay")
def qh3_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.simplices(_groups(spark, sf_dir), ["x", "y"], furthest=True).select("grp", "simplex", F.array_join("vertices", " ").alias("vertices"))


@query("qh4_voronoi_regions")
def qh4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.regions(Q.simplices(_groups(spark, sf_dir), ["x", "y"])).select("grp", "site", F.size("vertices").alias("n"))


@query("qh4_voronoi_ridges")
def qh4_ridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.ridges(Q.simplices(_groups(spark, sf_dir), ["x", "y"])).select("grp", "a", "b", F.size("vertices").alias("n"))


@query("qh5_halfspaces")
def qh5(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.sqrt(F.pow(F.col("x") - 8, 2) + F.pow(F.col("y") - 8, 2) + F.pow(F.col("z") - 8, 2))
    planes = _groups(spark, sf_dir).withColumn("u", unit).where("u > 0").select("grp", "id", *(((F.col(a) - 8) / F.col("u")).alias(a) for a in "xyz"), (-1 - F.col("u") / 16).alias("offset"))
    return Q.intersections(planes, ["x", "y", "z"], [0.0, 0.0, 0.0])


@query("qh7_point_generators")
def qh7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in ("cube", "cospherical", "disk", "lens", "spiral", "polygon", "simplex", "corners", "diamond", "mesh"):
        part = Q.generated(spark, kind, 200, 3, seed=1, width=0.1 if kind in ("disk",) else 0.0).select(F.lit(kind).alias("kind"), "id", *(F.round(f"x{i}", 9).alias(f"x{i}") for i in range(3)))
        out = part if out is None else out.unionByName(part)
    return out


@query("qh8_hull_measures")
def qh8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.hull_measures(Q.facets(_groups(spark, sf_dir), ["x", "y", "z"]), 3), "area", "volume")


@query("qh9_transforms", "select id, round(-1 + (x-lo)*2/(hi-lo), 9) as x from fx_tracers_box, (select min(x) as lo, max(x) as hi from fx_tracers_box) e")
def qh9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.scaled(load(spark, sf_dir, "fx_tracers_box").select("id", "x"), "x", -1.0, 1.0), "x", digits=9)


@query("qh11_t6_good_facets")
def qh11(spark: SparkSession, sf_dir: str) -> DataFrame:
    facets = Q.facets(_groups(spark, sf_dir), ["x", "y", "z"])
    return Q.largest_facets(Q.facets_within(Q.facets_seeing(facets, [30.0, 8.0, 8.0]), 0, low=0.5), 40).select("grp", "facet", F.round("area", 9).alias("area"))

