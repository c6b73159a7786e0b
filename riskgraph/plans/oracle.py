"""DuckDB SQL for the correctness oracle.

Each oracle query is a chain of CTEs over the driver's pre-registered
tables. CTE texts are registered by name with their dependencies; a query
names the CTEs it needs and :func:`build` emits them in dependency order.
The SQL states the reference semantics directly (self-joins and all); the
Spark side is free to plan differently, and the two must agree."""

from __future__ import annotations

from ..sources.fixtures import AS_OF, FIXTURE_DEPS, FIXTURE_SQL, SINCE

_CTES: dict[str, tuple[str, tuple[str, ...], bool]] = {}


def R6(expr: str, alias: str | None = None) -> str:
    """Reported 6-decimal rounding, same rule as ``functions.expr.r6``."""
    out = f"round(({expr}) + 1e-10, 6)"
    return f"{out} as {alias}" if alias else out


def cte(name: str, sql: str, deps: tuple[str, ...] = (), materialized: bool = False) -> None:
    _CTES[name] = (sql, deps, materialized)


for _n, _s in FIXTURE_SQL.items():
    cte(_n, _s, FIXTURE_DEPS[_n])


def build(body: str, needs: tuple[str, ...] | list[str]) -> str:
    order: list[str] = []
    seen: set[str] = set()

    def visit(n: str) -> None:
        if n in seen:
            return
        seen.add(n)
        for d in _CTES[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    parts = []
    for n in order:
        sql, _, mat = _CTES[n]
        parts.append(f"{n} AS {'MATERIALIZED ' if mat else ''}(\n{sql}\n)")
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


# -- seeds -----------------------------------------------------------------------
SEED_FILTER = ("ALER_COD_TIPO_ALERTA_VO in ('4110','4111','4112') "
               "or (ALER_COD_TIPO_ALERTA_VO = '4113' and aler_fecha_desactiv_vo is null)")
cte("seed_alerts", f"select * from alerts where {SEED_FILTER}", ("alerts",))
cte("seeds", "select distinct cont_rut, 1 as score from seed_alerts", ("seed_alerts",))

# -- forces -------------------------------------------------------------------------
cte("arcs_pos", "select PARU_RUT_E0, PARU_RUT_E2, Monto_IVA from arcs where Monto_IVA > 0", ("arcs",))
cte("recv_tot", "select PARU_RUT_E2, cast(sum(Monto_IVA) as bigint) as Total_IVA from arcs_pos group by PARU_RUT_E2",
    ("arcs_pos",))
cte("f_vat", """select a.PARU_RUT_E0 as emisor, a.PARU_RUT_E2 as receptor, round(a.Monto_IVA / t.Total_IVA, 4) as Fi
 from arcs_pos a join recv_tot t on a.PARU_RUT_E2 = t.PARU_RUT_E2""", ("arcs_pos", "recv_tot"))
cte("inv", """select dhdr_rut_emisor, dhdr_rut_recep, dhdr_iva, dhdr_mnt_total,
 strptime(cast(dhdr_fch_emis_int as varchar), '%Y%m%d') as dhdr_fch_emis_int
 from dte where dtdc_codigo in ('33','34')""", ("dte",))
cte("rep_detail", """select i.dhdr_rut_emisor, i.dhdr_rut_recep, i.dhdr_iva, i.dhdr_fch_emis_int,
 r.CONT_RUT_REPRESENTANTE, r.REPR_FECHA_INICIO_VO, r.REPR_FECHA_TERMINO_VO,
 (s.cont_rut is not null) as alerted
 from inv i join reps r on i.dhdr_rut_recep = r.CONT_RUT
 left join seeds s on r.CONT_RUT_REPRESENTANTE = s.cont_rut
 where i.dhdr_fch_emis_int >= r.REPR_FECHA_INICIO_VO
   and (i.dhdr_fch_emis_int <= r.REPR_FECHA_TERMINO_VO or r.REPR_FECHA_TERMINO_VO is null)
   and i.dhdr_iva > 0""", ("inv", "reps", "seeds"))
cte("rep_aggs", """select a1.dhdr_rut_emisor, a1.dhdr_rut_recep,
 cast(coalesce(a2.count1, 0) as bigint) as count1, cast(coalesce(a2.sum1, 0) as bigint) as sum1,
 a1.count2, a1.sum2 from
 (select dhdr_rut_emisor, dhdr_rut_recep, count(*) as count2, cast(sum(dhdr_iva) as bigint) as sum2
  from rep_detail group by 1, 2) a1
 left join
 (select dhdr_rut_emisor, dhdr_rut_recep, count(*) as count1, sum(dhdr_iva) as sum1
  from rep_detail where alerted group by 1, 2) a2
 on a1.dhdr_rut_emisor = a2.dhdr_rut_emisor and a1.dhdr_rut_recep = a2.dhdr_rut_recep""", ("rep_detail",))
cte("f_rep", """select * from (select dhdr_rut_emisor as emisor, dhdr_rut_recep as receptor,
 round((count1 / count2) / 2 + (sum1 / sum2) / 2, 5) as Fi from rep_aggs) where Fi > 0""", ("rep_aggs",))
cte("f_comb_all", """select coalesce(a.emisor, b.emisor) as emisor, coalesce(a.receptor, b.receptor) as receptor,
 coalesce(a.Fi, b.Fi) / 2 + coalesce(b.Fi, a.Fi) / 2 as Fi
 from f_rep a full join f_vat b on a.emisor = b.emisor and a.receptor = b.receptor""", ("f_rep", "f_vat"))
cte("f_comb", "select * from f_comb_all where Fi > 0", ("f_comb_all",))

FORCE_CTE = {"vat": "f_vat", "rep": "f_rep", "combined": "f_comb"}


def _prop_ctes(scenario: str, rounds: int) -> str:
    """Register the propagation CTEs of one scenario up to ``rounds``;
    returns the name of the last state."""
    p = f"{scenario}_"
    e = FORCE_CTE[scenario]
    cte(p + "infl", f"""select receptor, coalesce(exp(sum(ln(nullif(abs(1 - Fi), 0)))), 0) as f0, sum(Fi) as sFi
 from {e} group by receptor""", (e,))
    cte(p + "prep", f"""select emisor, receptor, Fi, f0,
 case when round((1 - f0) * Fi, 4) = 0 then round((1 - f0) * Fi, 4) else round((1 - f0) * Fi, 4) / sFi end as f
 from (select e.emisor, e.receptor, e.Fi, i.f0, i.sFi from {e} e left join {p}infl i on e.receptor = i.receptor)""",
        (e, p + "infl"), materialized=True)
    cte(p + "nodes", f"select distinct rut as cont_rut from (select emisor as rut from {p}prep "
                     f"union all select receptor from {p}prep)", (p + "prep",))
    cte(p + "s0", f"""select n.cont_rut, cast(case when s.score is not null and s.score > 0 then s.score else 0 end as double) as score
 from {p}nodes n left join seeds s on n.cont_rut = s.cont_rut""", (p + "nodes", "seeds"), materialized=True)
    for k in range(1, rounds + 1):
        prev = f"{p}s{k - 1}"
        cte(f"{p}s{k}", f"""select st.cont_rut,
 case when a.score1 is not null and a.score1 > st.score then a.score1 else st.score end as score
 from {prev} st left join (
   select x.receptor, sum(x.f * se.score) + avg(x.f0 * coalesce(sr.score, 0)) as score1
   from {p}prep x left join {prev} se on x.emisor = se.cont_rut
   left join {prev} sr on x.receptor = sr.cont_rut group by x.receptor) a
 on st.cont_rut = a.receptor""", (p + "prep", prev), materialized=True)
    return f"{p}s{rounds}"


def state_cte(scenario: str, rounds: int) -> str:
    return _prop_ctes(scenario, rounds)


# -- labels -------------------------------------------------------------------------
cte("lbl_paid", f"""select CONT_RUT as cont_rut, cast(sum(F29_C_89) as bigint) as total_pago_f29 from tax_forms
 where TIVA_COD_VALIDEZ = 1
   and strptime(concat(cast(F29_AGNO_MES_TRIBUTARIO_VO as varchar), '01'), '%Y%m%d') >= timestamp '{SINCE}'
 group by CONT_RUT""", ("tax_forms",))
cte("lbl_netvat", f"""select coalesce(e.dhdr_rut_emisor, r.dhdr_rut_recep) as cont_rut,
 cast(coalesce(r.iva_recibido, 0) - coalesce(e.iva_emitido, 0) as bigint) as IVA_neto
 from (select dhdr_rut_emisor, sum(dhdr_iva) as iva_emitido from inv
       where dhdr_fch_emis_int >= timestamp '{SINCE}' group by 1) e
 full join (select dhdr_rut_recep, sum(dhdr_iva) as iva_recibido from inv
       where dhdr_fch_emis_int >= timestamp '{SINCE}' group by 1) r
 on e.dhdr_rut_emisor = r.dhdr_rut_recep""", ("inv",))
cte("lbl_region", """select CONT_RUT as cont_rut, UNOP_DES_REGIONAL as unidad_regional from (
 select b.CONT_RUT, u.UNOP_DES_REGIONAL, row_number() over (partition by b.CONT_RUT
   order by b.NEGO_FECHA_VIGENCIA desc nulls last, u.UNOP_DES_REGIONAL asc nulls last) as rn
 from businesses b left join units u on b.UNOP_UNIDAD = u.UNOP_UNIDAD) where rn = 1""", ("businesses", "units"))
cte("lbl_docs", """select dhdr_rut_emisor as cont_rut, count(*) as n_documentos from dte
 where dtdc_codigo in ('33','34') group by dhdr_rut_emisor""", ("dte",))
cte("lbl_life", f"""select cont_rut, max(case when cont_fecha_constitucion_vo is null
   or cont_fecha_constitucion_vo > timestamp '{AS_OF}' then null
   else date_diff('day', cast(cont_fecha_constitucion_vo as date), cast(timestamp '{AS_OF}' as date)) end) as lifetime
 from taxpayers group by cont_rut""", ("taxpayers",))


def enrich_cte(scenario: str = "combined", rounds: int = 15) -> str:
    st = state_cte(scenario, rounds)
    name = f"{scenario}_enriched{rounds}"
    cte(name, f"""select s.cont_rut, s.score, p.total_pago_f29, v.IVA_neto, g.unidad_regional,
 d.n_documentos, l.lifetime, case when sd.cont_rut is null then 0 else 1 end as alerta_inicial
 from {st} s
 left join lbl_paid p on s.cont_rut = p.cont_rut
 left join lbl_netvat v on s.cont_rut = v.cont_rut
 left join lbl_region g on s.cont_rut = g.cont_rut
 left join lbl_docs d on s.cont_rut = d.cont_rut
 left join lbl_life l on s.cont_rut = l.cont_rut
 left join seeds sd on s.cont_rut = sd.cont_rut""",
        (st, "lbl_paid", "lbl_netvat", "lbl_region", "lbl_docs", "lbl_life", "seeds"), materialized=True)
    return name
