"""Containment graph of configuration snapshots, for all snapshots at once.

Resources are (snapshot_id, resource_id, resource_type, ...), edges (snapshot_id, source_id, target_id,
name). Every step is a join or an aggregate; parents, hops and depths are found by loops over tables in
the shared folder. Where several answers are equally near, the one with the least id is taken, so that
the result does not depend on an order of updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudsift.sources.scratch import cut

#: How near a container is to what it holds: fixed values.
SPECIFICITY = {
    "AWS::EC2::Subnet": 50,
    "AWS::AutoScaling::AutoScalingGroup": 40,
    "AWS::CloudFormation::Stack": 40,
    "AWS::ECS::Cluster": 40,
    "AWS::RDS::DBCluster": 40,
    "AWS::EC2::VPC": 30,
}
#: Resource types by role: fixed values.
NOT_SPATIAL = ["AWS::EC2::RouteTable", "AWS::EC2::NetworkAcl"]
IN_SUBNET = ["AWS::EC2::NetworkInterface", "AWS::Lambda::Function", "AWS::RDS::DBInstance"]
IN_VPC = [
    "AWS::EC2::Subnet", "AWS::EC2::RouteTable", "AWS::EC2::NetworkAcl", "AWS::EC2::NetworkInterface", "AWS::EC2::Instance", "AWS::EC2::NatGateway", "AWS::EC2::EIP",
    "AWS::ElasticLoadBalancingV2::LoadBalancer", "AWS::ElasticLoadBalancing::LoadBalancer", "AWS::Lambda::Function", "AWS::RDS::DBSubnetGroup", "AWS::RDS::DBInstance",
]
IN_BUCKET = ["AWS::S3::AccessPoint", "AWS::S3::MultiRegionAccessPoint"]
#: Association records that stand for an edge (fixed values): (type, source types, target types, label).
JOIN_RECORDS = [
    ("AWS::EC2::SubnetRouteTableAssociation", ["AWS::EC2::Subnet"], ["AWS::EC2::RouteTable"], "route table"),
    ("AWS::EC2::VPCGatewayAttachment", ["AWS::EC2::InternetGateway", "AWS::EC2::VPNGateway"], ["AWS::EC2::VPC"], "attached"),
    ("AWS::EC2::SubnetNetworkAclAssociation", ["AWS::EC2::Subnet"], ["AWS::EC2::NetworkAcl"], "network acl"),
]
#: Types that every account has: fixed values.
ACCOUNT_DEFAULTS = ["AWS::CodeDeploy::DeploymentConfig", "AWS::AppConfig::HostedConfigurationVersion", "AWS::Config::ConfigurationRecorder"]
DEFAULTS_ID = "__svc__AccountDefaults"
VPC, SUBNET, BUCKET = "AWS::EC2::VPC", "AWS::EC2::Subnet", "AWS::S3::Bucket"
NODE = ["snapshot_id", "resource_id"]


def types(resources: DataFrame) -> DataFrame:
    """(snapshot_id, resource_id, resource_type): of an id that bears several types, the least."""
    return resources.groupBy(*NODE).agg(F.min("resource_type").alias("resource_type"))


def parent_map(resources: DataFrame, edges: DataFrame) -> DataFrame:
    """O-76: (snapshot_id, resource_id, parent_id): the most specific container of each node."""
    name = F.lower("name")
    down, up = name.startswith("contains"), name.startswith("is contained in") | name.startswith("is member of")
    pairs = edges.select("snapshot_id", F.when(down, F.col("target_id")).when(up, F.col("source_id")).alias("resource_id"), F.when(down, F.col("source_id")).when(up, F.col("target_id")).alias("parent_id"), down.alias("down"))
    kinds = types(resources).select("snapshot_id", F.col("resource_id").alias("parent_id"), F.col("resource_type").alias("parent_type"))
    pairs = pairs.filter("resource_id is not null and resource_id <> parent_id").join(kinds, ["snapshot_id", "parent_id"])
    pairs = pairs.filter(~(F.col("down") & F.col("parent_type").isin(*NOT_SPATIAL)))
    rank = F.lit(10)
    for kind, value in SPECIFICITY.items():
        rank = F.when(F.col("parent_type") == kind, value).otherwise(rank)
    return pairs.groupBy(*NODE).agg(F.min(F.struct((-rank).alias("rank"), "parent_id"))["parent_id"].alias("parent_id"))


def neighbours(edges: DataFrame, every: bool = False) -> DataFrame:
    """(snapshot_id, resource_id, peer_id): edges both ways; without `every`, only those that contain nothing."""
    name = F.lower("name")
    kept = edges if every else edges.filter(~(name.startswith("contains") | name.startswith("is contained in") | name.startswith("is member of")))
    there = kept.select("snapshot_id", F.col("source_id").alias("resource_id"), F.col("target_id").alias("peer_id"))
    return there.unionByName(there.select("snapshot_id", F.col("peer_id").alias("resource_id"), F.col("resource_id").alias("peer_id"))).distinct()


def adopt(parents: DataFrame, resources: DataFrame, links: DataFrame, children: list[str], container: str) -> DataFrame:
    """Parents with those of orphans of some types that neighbour a container."""
    kinds = types(resources)
    orphans = kinds.filter(F.col("resource_type").isin(*children)).join(parents, NODE, "left_anti").select(*NODE)
    holders = kinds.filter(F.col("resource_type") == container).select("snapshot_id", F.col("resource_id").alias("peer_id"))
    found = orphans.join(links, NODE).join(holders, ["snapshot_id", "peer_id"]).groupBy(*NODE).agg(F.min("peer_id").alias("parent_id"))
    return parents.unionByName(found)


def infer_subnets(parents: DataFrame, resources: DataFrame, edges: DataFrame) -> DataFrame:
    """O-77: network interfaces, functions and database instances beside a subnet go into it."""
    return adopt(parents, resources, neighbours(edges), IN_SUBNET, SUBNET)


def infer_buckets(parents: DataFrame, resources: DataFrame, edges: DataFrame) -> DataFrame:
    """O-79: access points beside a bucket go into it."""
    return adopt(parents, resources, neighbours(edges, every=True), IN_BUCKET, BUCKET)


def ancestors(parents: DataFrame) -> DataFrame:
    """(snapshot_id, resource_id, ancestor_id, distance): the closure of the parents to its fix-point, doubled each round.

    Chains may be of any length. On a cycle each node is above all others once, at its least distance, and
    none is above itself, so that the closure ends.
    """
    paths = cut(parents.select(*NODE, F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance")), "paths")
    known = paths.count()
    while True:
        far = paths.select("snapshot_id", F.col("resource_id").alias("ancestor_id"), F.col("ancestor_id").alias("beyond"), F.col("distance").alias("more"))
        longer = paths.join(far, ["snapshot_id", "ancestor_id"]).select(*NODE, F.col("beyond").alias("ancestor_id"), (F.col("distance") + F.col("more")).alias("distance"))
        wider = cut(paths.unionByName(longer).filter(F.col("ancestor_id") != F.col("resource_id")).groupBy(*NODE, "ancestor_id").agg(F.min("distance").alias("distance")), "paths")
        if (now := wider.count()) == known:
            return wider
        paths, known = wider, now


def jumped(parents: DataFrame, marked: DataFrame) -> tuple[DataFrame, int]:
    """((NODE, top, hops, nearest, least, moving), rounds): pointers that are doubled until they rest at the top.

    One row for each node that has a parent: `hops` lie between it and `top`, `nearest` is the first of the
    `marked` nodes (NODE) on the way, `least` the least id. A node that is still moving when a pointer has passed
    as many nodes as there are lies on a cycle, or below one; its `top` is on the cycle.
    """
    own = marked.select(*(F.col(c).alias(f"{c}_") for c in NODE))
    met = parents.join(own, (F.col("snapshot_id") == F.col("snapshot_id_")) & (F.col("parent_id") == F.col("resource_id_")), "left")
    state = cut(met.select(*NODE, F.col("parent_id").alias("top"), F.lit(1).cast("long").alias("hops"), F.col("resource_id_").alias("nearest"), F.col("parent_id").alias("least"), F.lit(True).alias("moving")), "jumps")
    n, rounds = state.count(), 0
    while 1 << rounds <= 2 * n:
        far = state.select("snapshot_id", F.col("resource_id").alias("top"), *(F.col(c).alias(f"{c}_") for c in ("top", "hops", "nearest", "least")))
        step = state.join(far, ["snapshot_id", "top"], "left")
        state = cut(
            step.select(
                *NODE, F.coalesce("top_", "top").alias("top"), (F.col("hops") + F.coalesce("hops_", F.lit(0))).alias("hops"),
                F.coalesce("nearest", "nearest_").alias("nearest"), F.least("least", "least_").alias("least"), F.col("top_").isNotNull().alias("moving"),
            ),
            "jumps",
        )
        rounds += 1
        if not state.filter("moving").limit(1).count():
            break
    return state, rounds


def climbed(parents: DataFrame, marked: DataFrame) -> DataFrame:
    """(NODE, depth, nearest) of nodes that have a parent: how many nodes are above, and the nearest of the marked ones.

    All others of its cycle are above a node on one; below a cycle, all of it is.
    """
    state, _ = jumped(parents, marked)
    calm, round_ = state.filter(~F.col("moving")), state.filter("moving")
    if not round_.limit(1).count():
        return calm.select(*NODE, F.col("hops").alias("depth"), "nearest")
    # After that many rounds, the tops are all nodes of the cycles, and the least id on the way is the cycle's.
    cycle = cut(round_.select("snapshot_id", F.col("top").alias("resource_id")).distinct().join(round_.select(*NODE, "least", "nearest"), NODE), "cycle")
    sizes = cycle.groupBy("snapshot_id", "least").agg((F.count("*") - 1).alias("others"))
    on = cut(cycle.join(sizes, ["snapshot_id", "least"]).select(*NODE, F.col("others").alias("depth"), "nearest"), "on_cycle")
    tails, _ = jumped(parents.join(on.select(*NODE), NODE, "left_anti"), marked)
    entry = on.select("snapshot_id", F.col("resource_id").alias("top"), F.col("depth").alias("more"))
    below = tails.join(entry, ["snapshot_id", "top"]).join(round_.select(*NODE, F.col("nearest").alias("first")), NODE)
    return calm.select(*NODE, F.col("hops").alias("depth"), "nearest").unionByName(on).unionByName(below.select(*NODE, (F.col("hops") + F.col("more")).alias("depth"), F.col("first").alias("nearest")))


def infer_vpcs(parents: DataFrame, resources: DataFrame, edges: DataFrame) -> DataFrame:
    """O-78: residents without a VPC above them go into the nearest one over association edges."""
    kinds, links = types(resources), cut(neighbours(edges), "links")
    vpcs = kinds.filter(F.col("resource_type") == VPC).select(*NODE, F.col("resource_id").alias("vpc"))
    above = climbed(parents, vpcs.select(*NODE)).filter("nearest is not null").select(*NODE, F.col("nearest").alias("vpc"))
    placed = cut(vpcs.unionByName(above.join(vpcs.select(*NODE), NODE, "left_anti")), "placed")
    start = placed
    while True:
        reach = placed.select("snapshot_id", F.col("resource_id").alias("peer_id"), "vpc").join(links, ["snapshot_id", "peer_id"]).join(placed.select(*NODE), NODE, "left_anti")
        new = cut(reach.groupBy(*NODE).agg(F.min("vpc").alias("vpc")), "reach")
        if not new.limit(1).count():
            break
        placed = cut(placed.unionByName(new), "placed")
    lost = kinds.filter(F.col("resource_type").isin(*IN_VPC)).select(*NODE).join(start.select(*NODE), NODE, "left_anti")
    found = lost.join(placed, NODE).select(*NODE, F.col("vpc").alias("parent_id"))
    return parents.join(found.select(*NODE), NODE, "left_anti").unionByName(found)


def infer_parents(resources: DataFrame, edges: DataFrame) -> DataFrame:
    """O-76 to O-79 in their order."""
    parents = cut(parent_map(resources, edges), "parents")
    parents = cut(infer_subnets(parents, resources, edges), "parents")
    parents = cut(infer_vpcs(parents, resources, edges), "parents")
    return cut(infer_buckets(parents, resources, edges), "parents")


def zones(resources: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-80: (zone nodes, parents): VPCs over several zones get one node for each, which holds its subnets."""
    subnets = resources.filter(F.col("resource_type") == SUBNET).select(*NODE, F.get_json_object("configuration", "$.availabilityZone").alias("zone")).filter("zone is not null")
    inside = subnets.join(parents, NODE).join(resources.filter(F.col("resource_type") == VPC).select("snapshot_id", F.col("resource_id").alias("parent_id")), ["snapshot_id", "parent_id"])
    wide = inside.groupBy("snapshot_id", "parent_id").agg(F.count_distinct("zone").alias("n")).filter("n >= 2").select("snapshot_id", "parent_id")
    moved = inside.join(wide, ["snapshot_id", "parent_id"]).withColumn("zone_id", F.concat(F.lit("__az__"), "parent_id", F.lit("__"), "zone"))
    nodes = moved.select("snapshot_id", F.col("zone_id").alias("resource_id"), F.lit("AvailabilityZone").alias("resource_type"), F.col("zone").alias("resource_name"), "parent_id").distinct()
    kept = parents.join(moved.select(*NODE), NODE, "left_anti")
    return nodes, kept.unionByName(moved.select(*NODE, F.col("zone_id").alias("parent_id"))).unionByName(nodes.select(*NODE, "parent_id"))


def service(resource_type: Column) -> Column:
    """The second part of a type's name, or Other."""
    return F.coalesce(F.get(F.split(resource_type, "::"), 1), F.lit("Other"))


def folded(resources: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-82: (direct edges, ids of the association records that they replace)."""
    kinds, links = types(resources), neighbours(edges, every=True)
    peers = links.join(kinds.select("snapshot_id", F.col("resource_id").alias("peer_id"), F.col("resource_type").alias("peer_type")), ["snapshot_id", "peer_id"])
    both = None
    for kind, sources, targets, label in JOIN_RECORDS:
        own = kinds.filter(F.col("resource_type") == kind).join(peers, NODE).groupBy(*NODE).agg(
            F.min(F.when(F.col("peer_type").isin(*sources), F.col("peer_id"))).alias("source_id"), F.min(F.when(F.col("peer_type").isin(*targets), F.col("peer_id"))).alias("target_id")
        )
        own = own.filter("source_id is not null and target_id is not null").withColumn("name", F.lit(label))
        both = own if both is None else both.unionByName(own)
    return both.select("snapshot_id", "source_id", "target_id", "name").distinct(), both.select(*NODE)


def depths(nodes: DataFrame) -> DataFrame:
    """O-85: nodes with the number of containers above them."""
    far = climbed(nodes.filter("parent_id is not null").select(*NODE, "parent_id"), nodes.limit(0).select(*NODE)).select(*NODE, F.col("depth").cast("int").alias("depth"))
    return nodes.join(far, NODE, "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def build_graph(resources: DataFrame, edges: DataFrame, kinds: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """O-76 to O-86: (nodes, edges) of all snapshots; a list of types leaves those types, a limit so many nodes."""
    shown = resources.filter(F.col("resource_type").isin(*kinds)) if kinds else resources
    shown = shown.orderBy(*NODE).limit(limit) if limit else shown
    zone_nodes, parents = zones(resources, infer_parents(resources, edges))
    direct, gone = folded(resources, edges)
    nodes = shown.join(gone, NODE, "left_anti").select(*NODE, "resource_type", "resource_name").join(parents, NODE, "left")
    nodes = nodes.unionByName(zone_nodes)
    # A container that is not shown holds nothing.
    there = nodes.select("snapshot_id", F.col("resource_id").alias("parent_id"), F.lit(True).alias("there"))
    nodes = nodes.join(there, ["snapshot_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("there"), F.col("parent_id"))).drop("there")
    # O-81, O-83: orphans go under their service, low-signal ones under a group of their own.
    group = F.when(F.col("resource_type").isin(*ACCOUNT_DEFAULTS), DEFAULTS_ID).when(F.col("parent_id").isNull() & (F.col("resource_type") != VPC), F.concat(F.lit("__svc__"), service(F.col("resource_type"))))
    nodes = cut(nodes.withColumn("parent_id", F.coalesce(group, "parent_id")), "nodes")
    groups = nodes.filter(F.col("parent_id").startswith("__svc__")).groupBy("snapshot_id", F.col("parent_id").alias("resource_id")).agg(F.count("*").alias("member_count"))
    groups = groups.select("snapshot_id", "resource_id", F.lit("ServiceGroup").alias("resource_type"), F.expr("substring(resource_id, 8)").alias("resource_name"), F.lit(None).cast("string").alias("parent_id"), "member_count")
    nodes = depths(cut(nodes.withColumn("member_count", F.lit(None).cast("long")).unionByName(groups), "nodes"))
    # O-84: edges that are no containment, between nodes that are shown.
    plain = edges.filter(~F.lower("name").startswith("contains") & ~F.lower("name").startswith("is contained in")).select("snapshot_id", "source_id", "target_id", "name").unionByName(direct)
    for end in ("source_id", "target_id"):
        plain = plain.join(nodes.select("snapshot_id", F.col("resource_id").alias(end)), ["snapshot_id", end], "left_semi")
    return nodes, plain.distinct()


def snapshot_list(snapshots: DataFrame) -> DataFrame:
    """O-75: the snapshots, the newest first."""
    return snapshots.orderBy(F.col("captured_at").desc_nulls_last(), "snapshot_id")


def resource_types(resources: DataFrame, snapshot_id: str | None = None) -> DataFrame:
    """O-75: the types that a snapshot (or each of them) holds."""
    own = resources.filter(F.col("snapshot_id") == snapshot_id) if snapshot_id is not None else resources
    return own.select("snapshot_id", "resource_type").distinct()


def resource_detail(resources: DataFrame, snapshot_id: str, resource_id: str, resource_type: str | None = None) -> DataFrame:
    """O-75: all that is known of one resource: of the given type, else of the least of its types."""
    own = resources.filter((F.col("snapshot_id") == snapshot_id) & (F.col("resource_id") == resource_id))
    own = own.filter(F.col("resource_type") == resource_type) if resource_type is not None else own
    return own.orderBy("resource_type").limit(1)
