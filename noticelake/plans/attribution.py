"""The decision list that attributes a notice, as one CASE over columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.operators.aggregates import at_least


@dataclass(frozen=True)
class Inputs:
    """Columns that the decisions read; booleans but for the ones named otherwise."""

    foreign: Column
    hint: Column  # nation named in the text, or null
    hint_is_target: Column
    confirmed: Column
    rejected: Column
    has_centroid: Column
    fir_method: Column  # icao, text, geo, outside:X, too_far:N or -
    fir_nations: Column  # array of target nations of the airspace
    fir_country_is_target: Column
    fir_distance_km: Column
    level: Column
    has_site: Column
    distance_km: Column
    implausible: Column


#: Branches that leave a notice open for a group of notices to decide.
OPEN_BRANCHES = (4, 9, 10, 11)


def decided(x: Inputs, near_fir_km: float = 800.0) -> Column:
    """struct(branch, status, requires_group): the first rule that fits decides; no evidence means no attribution.

    Rules 3, 7 and 8 only choose the nations and go on, so they have no branch of their own;
    null conditions count as false, and 1 to 17 are the rules' numbers.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    no_fir = ~yes(x.fir_method.isin("icao", "text", "geo"))
    goes_on = yes(x.confirmed) | (x.hint.isNotNull() & yes(x.hint_is_target))  # rules 3, 7 and 8
    sure = yes(at_least(x.level))
    loose = yes((x.fir_method == "-") | x.fir_method.startswith("too_far"))
    rules = [
        (1, yes(x.foreign) & x.hint.isNull() & ~yes(x.confirmed)),
        (2, ~yes(x.has_centroid)),
        (4, no_fir & ~goes_on & loose & sure),
        (5, no_fir & ~goes_on),
        (6, ~no_fir & (F.coalesce(F.size(x.fir_nations), F.lit(0)) == 0) & ~yes(x.confirmed)),
        (9, ~no_fir & ~goes_on & (x.fir_method == "geo") & yes(x.fir_distance_km > near_fir_km)),
        (10, ~no_fir & ~goes_on & ~yes(x.fir_country_is_target)),
        (11, ~no_fir & ~goes_on & (F.size(x.fir_nations) > 1)),
        (12, ~sure & ~yes(x.confirmed)),
        (13, ~yes(x.has_site)),
        (14, yes(x.distance_km < 1)),
        (15, yes(x.implausible)),
        (16, yes(x.distance_km > 20_000)),
    ]
    branch = F.lit(17)
    for number, condition in reversed(rules):
        branch = F.when(condition, number).otherwise(branch)
    fine = (branch == 17) | (branch.isin(2, 15) & yes(x.confirmed))
    status = F.when(fine & ~yes(x.rejected), "OK").otherwise("REVIEW")
    return F.struct(branch.alias("branch"), status.alias("status"), branch.isin(*OPEN_BRANCHES).alias("requires_group"))
