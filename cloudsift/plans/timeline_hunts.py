"""Hunts over the detection timeline as grouped specifications and a few functions.

The timeline has one row for each rule match: Timestamp, RuleTitle, Level, EventName, EventSource,
AwsRegion, ErrorCode, SrcIP, UserAgent, UserName, UserType, UserARN, UserAccessKeyID, EventID, and the
lists Tactics, TechniqueIDs and OtherTags. Levels compare by their rank.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudsift.operators import combine as C
from cloudsift.operators import group as G
from cloudsift.operators.shape import level_rank, melt_measures
from cloudsift.sources.scratch import cut


def rank() -> Column:
    """The row's severity, 1 to 5."""
    return level_rank(F.col("Level"))


def severe() -> Column:
    """High or critical."""
    return rank() >= 4


#: Aggregates that many hunts share.
MEASURES: dict[str, Callable[[], Column | G.Text]] = {
    "detections": lambda: F.count("*"),
    "severe": lambda: F.count_if(severe()),
    "medium": lambda: F.count_if(rank() == 3),
    "rules": lambda: F.count_distinct("RuleTitle"),
    "rule_list": lambda: G.joined("RuleTitle"),
    "principals": lambda: F.count_distinct("UserARN"),
    "source_ips": lambda: F.count_distinct("SrcIP"),
    "distinct_events": lambda: F.count_distinct("EventID"),
    "distinct_actions": lambda: F.count_distinct("EventName"),
    "distinct_errors": lambda: F.count_distinct("ErrorCode"),
    "regions": lambda: F.count_distinct("AwsRegion"),
    "region_list": lambda: G.joined("AwsRegion"),
    "variants": lambda: F.count_distinct("UserAgent"),
    "first_seen": lambda: F.min("Timestamp"),
    "last_seen": lambda: F.max("Timestamp"),
    "active_days": lambda: F.count_distinct(F.to_date("Timestamp")),
    "max_rank": lambda: F.max(rank()),
    "failed": lambda: F.count("ErrorCode"),
    "failures": lambda: F.count("*"),
    "on_weekend": lambda: F.count_if(F.weekday("Timestamp") >= 5),
    "last_action": lambda: G.first_of("EventName", "Timestamp", largest=True),
    "last_user_agent": lambda: G.Text("last_user_agent", "UserAgent", "newest", "Timestamp"),
    "sample_event_id": lambda: F.min("EventID"),
    "event_name": lambda: F.min("EventName"),
    "user_arn": lambda: F.min("UserARN"),
    "src_ip": lambda: F.min("SrcIP"),
}



def measures(*names: str) -> list[Column | G.Text]:
    """Shared aggregates under their names."""
    made = {n: MEASURES[n]() for n in names}
    return [m if isinstance(m, G.Text) else m.alias(n) for n, m in made.items()]


DAY, HOUR = (lambda: F.date_trunc("day", "Timestamp")), (lambda: F.date_trunc("hour", "Timestamp"))


@dataclass(frozen=True)
class GroupHunt:
    """keys map names to expressions; order lists measures or keys, a leading plus rises."""

    severity: str
    keys: Mapping[str, Callable[[], Column]]
    measures: Sequence[str]
    order: Sequence[str]
    limit: int
    where: Callable[[], Column] | None = None
    having: Callable[[], Column] | None = None
    explode: str | None = None
    named: str = ""
    more: Mapping[str, Callable[[], Column | G.Text]] = field(default_factory=dict)

    def run(self, timeline: DataFrame, whole: bool = False) -> DataFrame:
        """The first `limit` groups in order, or all in none; ties go by the keys."""
        df = timeline.filter(self.where()) if self.where else timeline
        df = df.withColumn(self.named, F.explode(self.explode)) if self.explode else df
        aggs = measures(*self.measures) + [c() for c in self.more.values()]
        order = [F.col(o[1:]).asc_nulls_last() if o[0] == "+" else F.col(o).desc_nulls_last() for o in self.order]
        order += [F.col(k).asc_nulls_last() for k in self.keys if k not in {o.lstrip("+") for o in self.order}]
        return G.group_hunt(df, [c().alias(n) for n, c in self.keys.items()], aggs, None, self.having() if self.having else None, order, G.ANY_ORDER if whole else self.limit)


def col(*names: str) -> dict[str, Callable[[], Column]]:
    """Plain keys."""
    return {n: (lambda n=n: F.col(n)) for n in names}


def known(name: str) -> Callable[[], Column]:
    """Rows with a value."""
    return lambda: F.col(name).isNotNull()


RULE = {**col("RuleTitle", "Level")}
AGENT = {"agent_family": lambda: F.element_at(F.split("UserAgent", "[/ ]"), 1)}
OFF_HOURS = lambda: (F.hour("Timestamp") < 6) | (F.hour("Timestamp") >= 22) | (F.weekday("Timestamp") >= 5)
ROOT = lambda: (F.lower("UserType") == "root") | F.col("UserARN").endswith(":root")
FAMILY = {"error_family": lambda: F.when(F.lower("ErrorCode").rlike("denied|unauthorized|forbidden"), "authorization").when(F.lower("ErrorCode").rlike("throttl|limit"), "throttling").when(F.lower("ErrorCode").rlike("notfound|nosuch"), "not found").otherwise("other")}
CREDENTIAL = lambda: F.array_contains("Tactics", "CredAccess") | F.array_contains("Tactics", "InitAccess")

HUNTS: dict[str, GroupHunt] = {
    "T002": GroupHunt("P4", col("Level"), ["max_rank", "detections", "distinct_events", "rules", "first_seen", "last_seen"], ["max_rank"], 10),
    "T003": GroupHunt("P4", {"day": DAY}, ["detections", "severe", "medium", "principals"], ["day"], 365),
    "T004": GroupHunt("P2", {"hour": HOUR}, ["detections", "severe", "principals", "rules", "source_ips"], ["detections", "severe"], 100),
    "T005": GroupHunt("P2", {**col("UserARN"), "hour_of_day": lambda: F.hour("Timestamp")}, ["detections", "severe", "on_weekend", "rules", "first_seen", "last_seen"], ["severe", "detections"], 100, OFF_HOURS),
    "T006": GroupHunt("P2", col("UserARN"), ["first_seen", "last_seen", "active_days", "detections", "severe", "rules"], ["severe", "detections"], 100, known("UserARN")),
    "T007": GroupHunt("P3", RULE, ["detections", "principals", "source_ips", "first_seen", "last_seen"], ["detections"], 50),
    "T008": GroupHunt("P3", RULE, ["detections", "max_rank", "first_seen", "event_name", "user_arn", "src_ip", "sample_event_id"], ["max_rank", "first_seen"], 200, having=lambda: F.col("detections") == 1),
    "T009": GroupHunt("P3", RULE, ["first_seen", "last_seen", "detections"], ["first_seen"], 100),
    "T010": GroupHunt("P2", col("UserARN", "UserType"), ["severe", "medium", "detections", "rules", "source_ips", "first_seen", "last_seen"], ["severe", "detections"], 50, known("UserARN")),
    "T011": GroupHunt("P1", col("UserARN"), ["detections", "severe", "rules", "source_ips", "first_seen", "last_seen"], ["tactics", "severe"], 100, known("UserARN"), lambda: F.col("tactics") >= 3, "Tactics", "tactic", {"tactics": lambda: F.count_distinct("tactic").alias("tactics"), "tactic_spread": lambda: G.Text("tactic_spread", "tactic")}),
    "T012": GroupHunt("P1", {"day": DAY, **col("EventName", "RuleTitle")}, ["max_rank", "detections", "failed", "source_ips", "regions", "sample_event_id"], ["day", "detections"], 200, ROOT),
    "T015": GroupHunt("P3", col("SrcIP"), ["rules", "detections", "severe", "principals", "first_seen", "last_seen"], ["rules", "severe"], 100, known("SrcIP")),
    "T017": GroupHunt("P3", col("SrcIP"), ["first_seen", "last_seen", "detections", "severe", "principals", "rules"], ["first_seen", "severe"], 100, known("SrcIP")),
    "T018": GroupHunt("P4", AGENT, ["detections", "severe", "variants", "principals", "source_ips", "last_user_agent"], ["severe", "detections"], 100, known("UserAgent")),
    "T019": GroupHunt("P3", {"day": DAY, **col("UserARN")}, ["regions", "detections", "region_list"], ["regions", "day"], 100, known("UserARN"), lambda: F.col("regions") > 1),
    "T020": GroupHunt("P3", {**col("ErrorCode"), **FAMILY, **col("UserARN")}, ["failures", "distinct_actions", "source_ips", "last_action", "first_seen", "last_seen"], ["failures"], 100, known("ErrorCode")),
    "T022": GroupHunt("P2", {**col("UserARN"), "hour": HOUR}, ["failures", "distinct_actions", "distinct_errors", "source_ips", "last_action"], ["failures", "hour"], 100, known("ErrorCode"), lambda: F.col("failures") >= 5),
    "T023": GroupHunt("P4", col("technique"), ["detections", "severe", "rules", "principals"], ["severe", "detections"], 100, explode="TechniqueIDs", named="technique"),
    "T024": GroupHunt("P4", col("tactic"), ["detections", "severe", "rules", "principals"], ["severe", "detections"], 100, explode="Tactics", named="tactic"),
    "T025": GroupHunt("P4", RULE, ["detections"], ["detections"], 100, explode="TechniqueIDs", named="technique", more={"techniques": lambda: G.joined("technique").alias("techniques")}),
    "T027": GroupHunt("P1", col("UserAccessKeyID", "UserARN"), ["detections", "rules", "rule_list", "max_rank", "first_seen", "last_seen"], ["detections"], 100, CREDENTIAL),
    "T028": GroupHunt("P3", col("tactic"), ["detections", "severe", "rules", "principals", "first_seen", "last_seen"], ["severe", "detections"], 100, explode="Tactics", named="tactic"),
}


def newest(df: DataFrame, by_level: bool, limit: int | None = 200) -> DataFrame:
    """Rows by level, then time, newest first; ties go by event and rule."""
    first = [rank().desc_nulls_last()] if by_level else []
    return G.top(df, limit, *first, F.col("Timestamp").desc_nulls_last(), F.col("EventID").asc_nulls_last(), F.col("RuleTitle").asc_nulls_last())


def t001_severe(df: DataFrame, limit: int | None = 200) -> DataFrame:
    """Critical and high detections."""
    return newest(df.filter(severe()), False, limit)


def t013_access_keys(df: DataFrame, limit: int | None = 200) -> DataFrame:
    """The fifty worst access keys of each kind; all keys without a limit."""
    key = F.col("UserAccessKeyID")
    kind = F.when(key.startswith("ASIA"), "temporary").when(key.startswith("AKIA"), "long-lived").otherwise("other")
    names = ("user_arn", "detections", "severe", "source_ips", "rules", "first_seen", "last_seen")
    groups = G.grouped(df.filter(key.isNotNull()), ["UserAccessKeyID", kind.alias("key_type")], measures(*names))
    order = [F.desc("severe"), F.desc("detections"), F.asc("UserAccessKeyID")]
    if not limit:
        return groups
    return G.top(G.top_per_group(groups, ["key_type"], order, 50), limit, *order)


def t014_unattributed(df: DataFrame, limit: int | None = 200) -> DataFrame:
    """Detections without a principal, or of a service."""
    return newest(df.filter("UserARN is null or UserType = 'AWSService'"), True, limit)


def t016_fan_out(df: DataFrame, limit: int | None = 200) -> DataFrame:
    """Addresses of several principals, and principals on several addresses."""
    names = ("detections", "severe", "rules", "first_seen", "last_seen")
    # Pairs with their facts are made once; their numbers of each side come from them.
    facts = cut(df.filter("SrcIP is not null and UserARN is not null").groupBy("SrcIP", "UserARN").agg(*measures(*names)), "pairs")
    sides = facts.groupBy("SrcIP").agg(F.count("*").alias("principals_on_ip")), facts.groupBy("UserARN").agg(F.count("*").alias("ips_for_principal"))
    pairs = facts.join(sides[0], "SrcIP").join(sides[1], "UserARN").filter("principals_on_ip > 1 or ips_for_principal > 1")
    return G.top(pairs.select("SrcIP", "UserARN", "principals_on_ip", "ips_for_principal", *names), limit, F.desc("principals_on_ip"), F.desc("ips_for_principal"), F.desc("severe"), "SrcIP", "UserARN")


def t021_denied_then_allowed(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """An action that a principal was denied and did later."""
    keys = ["UserARN", "EventName"]
    denied = df.filter("ErrorCode is not null").groupBy(*keys).agg(F.count("*").alias("denials"), F.min("Timestamp").alias("first_denied"))
    allowed = df.filter("ErrorCode is null").groupBy(*keys).agg(F.min("Timestamp").alias("first_allowed"), G.first_of("EventID", "Timestamp").alias("allowed_event"))
    out = C.sequence_join(denied, allowed, keys, "first_denied", "first_allowed")
    return G.top(out.withColumn("minutes", G.boundaries(F.col("first_denied"), F.col("first_allowed"), "minute")), limit, "minutes", F.desc("denials"), *keys)


def t026_impact(df: DataFrame, limit: int | None = 200) -> DataFrame:
    """Detections of impact."""
    return newest(df.filter(F.array_contains("Tactics", "Impact")), True, limit)


def t029_indicators(df: DataFrame, limit: int | None = 300) -> DataFrame:
    """Addresses, principals and keys as one sheet."""
    sheet = C.indicators(df, {"source_ip": "SrcIP", "principal": "UserARN", "access_key": "UserAccessKeyID"}, measures("detections", "severe", "rules", "first_seen", "last_seen"))
    return G.top(sheet, limit, F.desc("severe"), F.desc("detections"), "type", "value")


def t030_co_occurrence(df: DataFrame, limit: int | None = 100) -> DataFrame:
    """Rules that fire for one principal in one hour."""
    return G.top(C.co_occurrence(df, "UserARN", F.date_trunc("hour", "Timestamp"), "RuleTitle"), limit, F.desc("together"), "item_a", "item_b")


#: id: (severity, function).
FUNCTIONS = {
    "T001": ("P1", t001_severe), "T013": ("P2", t013_access_keys), "T014": ("P2", t014_unattributed), "T016": ("P2", t016_fan_out), "T021": ("P1", t021_denied_then_allowed), "T026": ("P1", t026_impact),
    "T029": ("P2", t029_indicators), "T030": ("P3", t030_co_occurrence),
}


def run(key: str, timeline: DataFrame, whole: bool = False) -> DataFrame:
    """A hunt by its id; whole leaves out the report's limit and order."""
    if key in HUNTS:
        return HUNTS[key].run(timeline, whole)
    return FUNCTIONS[key][1](timeline, G.ANY_ORDER) if whole else FUNCTIONS[key][1](timeline)


def comparison(result: DataFrame, key: str) -> DataFrame:
    """The counts of a result in long form."""
    return melt_measures(result, [key], [m for m in ("detections", "severe", "rules") if m in result.columns])
