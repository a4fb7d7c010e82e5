"""Ancillary-service stacking for a storage asset at a given state of charge.

One row is one interval: service prices, state of charge and headroom are
columns. Contingency services share the same megawatts; regulation is added on
top of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quarters import as_column

INTERVAL_HOURS = 5.0 / 60.0

# Fixed values per service: price column, sustained duration (h), availability factor.
RAISE_SERVICES = {
    "REG_RAISE": ("fcas_reg_raise_aud_per_mw", 5.0 / 60.0, 0.70),
    "RAISE_1SEC": ("fcas_raise_1sec_aud_per_mw", 1.0 / 3600.0, 0.92),
    "RAISE_6SEC": ("fcas_raise_6sec_aud_per_mw", 6.0 / 3600.0, 0.90),
    "RAISE_60SEC": ("fcas_raise_60sec_aud_per_mw", 60.0 / 3600.0, 0.88),
    "RAISE_5MIN": ("fcas_raise_5min_aud_per_mw", 5.0 / 60.0, 0.85),
}
LOWER_SERVICES = {
    "REG_LOWER": ("fcas_reg_lower_aud_per_mw", 5.0 / 60.0, 0.70),
    "LOWER_1SEC": ("fcas_lower_1sec_aud_per_mw", 1.0 / 3600.0, 0.92),
    "LOWER_6SEC": ("fcas_lower_6sec_aud_per_mw", 6.0 / 3600.0, 0.90),
    "LOWER_60SEC": ("fcas_lower_60sec_aud_per_mw", 60.0 / 3600.0, 0.88),
    "LOWER_5MIN": ("fcas_lower_5min_aud_per_mw", 5.0 / 60.0, 0.85),
}


@dataclass(frozen=True)
class StackConfig:
    soc_min: float = 0.05
    soc_max: float = 0.95
    regulation_soc_min: float = 0.10
    regulation_soc_max: float = 0.90
    taper_width: float = 0.15
    min_enablement: float = 0.05
    regulation_mwh_per_mw: float = 0.003
    degradation_aud_per_mwh: float = 5.0
    allocation: str = "contingency_first"
    regulation_reserve: float = 0.30
    direction_priority: str = "revenue_weighted"
    activation: dict[str, str] = field(default_factory=dict)


def _regulation_cost(mw: Column, activation: Column, config: StackConfig) -> Column:
    return mw * config.regulation_mwh_per_mw * activation * config.degradation_aud_per_mwh


def fcas_costack(
    df: DataFrame,
    direction: str,
    headroom_mw,
    soc_fraction,
    energy_mwh,
    rated_mw,
    config: StackConfig = StackConfig(),
) -> DataFrame:
    """Add a struct column ``raise_stack`` or ``lower_stack`` with the enabled services of one direction."""
    services = RAISE_SERVICES if direction == "raise" else LOWER_SERVICES
    headroom, soc = as_column(headroom_mw), as_column(soc_fraction)
    energy, rated = as_column(energy_mwh), as_column(rated_mw)
    distance = (soc - config.soc_min) if direction == "raise" else (F.lit(config.soc_max) - soc)
    regulation_label = next(iter(services))
    floor_mw = rated * config.min_enablement

    # Feasible MW of each service on its own; NULL marks a service that cannot be enabled.
    feasible = []
    for label, (price_column, hours, availability) in services.items():
        price = F.coalesce(F.col(price_column).cast("double"), F.lit(0.0))
        tapered = F.when(distance < config.taper_width, distance / config.taper_width).otherwise(F.lit(1.0))
        mw = F.least(headroom * availability * tapered, F.greatest(F.lit(0.0), distance * energy / hours))
        usable = (price > 0) & (headroom > 0) & (distance > 0)
        if label == regulation_label:
            usable = usable & soc.between(config.regulation_soc_min, config.regulation_soc_max)
        feasible.append(F.when(usable, mw).alias(f"_mw_{label}"))
        feasible.append(price.alias(f"_price_{label}"))
        activation = config.activation.get(label)
        feasible.append(
            (F.coalesce(F.col(activation), F.lit(1.0)) if activation else F.lit(1.0)).alias(f"_act_{label}")
        )
    staged = df.select("*", headroom.alias("_headroom"), floor_mw.alias("_floor_mw"), *feasible)

    kept = []
    for label in services:
        mw, price = F.col(f"_mw_{label}"), F.col(f"_price_{label}")
        net = price * mw * INTERVAL_HOURS
        if label == regulation_label:
            net = net - _regulation_cost(mw, F.col(f"_act_{label}"), config)
        kept.append(F.when((mw >= F.col("_floor_mw")) & (net > 0), mw).alias(f"_q_{label}"))
    staged = staged.select("*", *kept)

    contingency = [label for label in services if label != regulation_label]
    cont_max = F.coalesce(F.greatest(*[F.col(f"_q_{label}") for label in contingency]), F.lit(0.0))
    reg_q, reg_price = F.col(f"_q_{regulation_label}"), F.col(f"_price_{regulation_label}")
    reg_activation = F.col(f"_act_{regulation_label}")

    def regulation(room: Column) -> Column:
        """Regulation MW that fits into ``room``; 0 when it does not pay."""
        mw = F.least(reg_q, room)
        net = reg_price * mw * INTERVAL_HOURS - _regulation_cost(mw, reg_activation, config)
        fits = reg_q.isNotNull() & (mw >= F.col("_floor_mw")) & (net > 0)
        return F.when(fits, mw).otherwise(F.lit(0.0))

    staged = staged.select("*", cont_max.alias("_cont_max"))
    cont_max, room = F.col("_cont_max"), F.col("_headroom")

    def allocated(frame: DataFrame, name: str, cont_mw: Column) -> DataFrame:
        frame = frame.select("*", cont_mw.alias(f"_c_{name}"))
        cont = F.col(f"_c_{name}")
        frame = frame.select("*", regulation(F.greatest(F.lit(0.0), room - cont)).alias(f"_r_{name}"))
        reg = F.col(f"_r_{name}")
        reg_net = reg_price * reg * INTERVAL_HOURS - _regulation_cost(reg, reg_activation, config)
        revenues = {label: F.col(f"_price_{label}") * cont * INTERVAL_HOURS for label in contingency}
        revenues = {k: F.when(F.col(f"_q_{k}").isNotNull(), v).otherwise(F.lit(0.0)) for k, v in revenues.items()}
        revenues[regulation_label] = F.when(reg > 0, reg_net).otherwise(F.lit(0.0))
        frame = frame.select("*", *[v.alias(f"_v_{name}_{k}") for k, v in revenues.items()])
        earned = {k: F.col(f"_v_{name}_{k}") for k in revenues}
        cont_revenue = F.lit(0.0)
        for label in contingency:
            cont_revenue = cont_revenue + earned[label]
        top = F.greatest(*earned.values())
        # The first service with the highest positive revenue; contingency services come first.
        best = F.when(top <= 0, F.lit("NONE"))
        for label, revenue in earned.items():
            best = best.when(revenue == top, F.lit(label))
        entries = [
            F.when(
                (reg > 0) if label == regulation_label else F.col(f"_q_{label}").isNotNull(),
                F.struct(
                    F.lit(label).alias("label"),
                    (reg if label == regulation_label else cont).alias("enabled_mw"),
                    F.col(f"_price_{label}").alias("price"),
                    revenue.alias("revenue"),
                    F.lit(label == regulation_label).alias("is_regulation"),
                ),
            )
            for label, revenue in earned.items()
        ]
        return frame.select(
            "*",
            F.struct(
                (cont + reg).alias("total_mw"),
                (cont_revenue + earned[regulation_label]).alias("total_revenue"),
                cont.alias("cont_mw"),
                reg.alias("reg_mw"),
                cont_revenue.alias("cont_revenue"),
                earned[regulation_label].alias("reg_revenue"),
                best.alias("best_label"),
                F.array_compact(F.array(*entries)).alias("services"),
            ).alias(f"_stack_{name}"),
        )

    if config.allocation == "revenue_maximising":
        staged = allocated(staged, "a", cont_max)
        staged = staged.select("*", regulation(room).alias("_reg_first"))
        staged = allocated(staged, "b", F.least(cont_max, F.greatest(F.lit(0.0), room - F.col("_reg_first"))))
        chosen = F.when(
            F.col("_stack_b.total_revenue") > F.col("_stack_a.total_revenue"), F.col("_stack_b")
        ).otherwise(F.col("_stack_a"))
    elif config.allocation == "guaranteed_reg_min":
        staged = allocated(staged, "a", F.least(cont_max, room - room * config.regulation_reserve))
        chosen = F.col("_stack_a")
    else:
        staged = allocated(staged, "a", cont_max)
        chosen = F.col("_stack_a")
    return staged.select(*df.columns, chosen.alias(f"{direction}_stack"))


def _scaled(stack: Column, factor: Column) -> Column:
    """The same services at ``factor`` of their MW: revenue and regulation cost are proportional to MW."""
    def shrink(s: Column) -> Column:
        return F.struct(
            s["label"].alias("label"), (s["enabled_mw"] * factor).alias("enabled_mw"), s["price"].alias("price"),
            (s["revenue"] * factor).alias("revenue"), s["is_regulation"].alias("is_regulation"),
        )

    amounts = ("total_mw", "total_revenue", "cont_mw", "reg_mw", "cont_revenue", "reg_revenue")
    shrunk = F.struct(
        *[(stack[c] * factor).alias(c) for c in amounts],
        F.when(factor > 0, stack["best_label"]).otherwise(F.lit("NONE")).alias("best_label"),
        F.transform(stack["services"], shrink).alias("services"),
    )
    return F.when(factor >= 1.0, stack).otherwise(shrunk)


def fcas_direction_priority(df: DataFrame, budget_mw, config: StackConfig = StackConfig()) -> DataFrame:
    """Shrink ``raise_stack`` and ``lower_stack`` so that both fit a shared budget."""
    up, down = F.col("raise_stack"), F.col("lower_stack")
    staged = df.select("*", as_column(budget_mw).alias("_budget"))
    budget, mw_up, mw_down = F.col("_budget"), up["total_mw"], down["total_mw"]
    if config.direction_priority == "revenue_weighted":
        revenue = up["total_revenue"] + down["total_revenue"]
        share_up = F.when(revenue > 0, F.try_divide(up["total_revenue"], revenue)).otherwise(F.lit(0.5))
        share_down = F.when(revenue > 0, F.try_divide(down["total_revenue"], revenue)).otherwise(F.lit(0.5))
        first_up, first_down = F.least(mw_up, budget * share_up), F.least(mw_down, budget * share_down)
        up_has_slack = first_up < budget * share_up
        down_has_slack = ~up_has_slack & (first_down < budget * share_down)
        give_up = F.when(down_has_slack, F.least(mw_up, budget - first_down)).otherwise(first_up)
        give_down = F.when(up_has_slack, F.least(mw_down, budget - first_up)).otherwise(first_down)
    elif config.direction_priority == "prefer_raise":
        give_up = F.least(mw_up, budget)
        give_down = F.least(mw_down, F.greatest(F.lit(0.0), budget - give_up))
    elif config.direction_priority == "prefer_lower":
        give_down = F.least(mw_down, budget)
        give_up = F.least(mw_up, F.greatest(F.lit(0.0), budget - give_down))
    else:
        give_up = mw_up * F.try_divide(budget, mw_up + mw_down)
        give_down = mw_down * F.try_divide(budget, mw_up + mw_down)
    binding = ((mw_up + mw_down) > budget) & ((mw_up + mw_down) > 0)
    staged = staged.select(
        "*",
        F.when(binding, F.coalesce(F.try_divide(give_up, mw_up), F.lit(0.0))).otherwise(F.lit(1.0)).alias("_f_up"),
        F.when(binding, F.coalesce(F.try_divide(give_down, mw_down), F.lit(0.0))).otherwise(F.lit(1.0)).alias("_f_dn"),
    )
    kept = [c for c in df.columns if c not in ("raise_stack", "lower_stack")]
    return staged.select(
        *kept,
        _scaled(up, F.col("_f_up")).alias("raise_stack"),
        _scaled(down, F.col("_f_dn")).alias("lower_stack"),
    )
