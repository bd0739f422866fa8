"""Behaviour events of the recommendation's wire form mapped to platform events: each source checked, bound to a subject and an exposure, and written anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import quoted
from ..sources.tables import Domain
from .registry import query

# Wire names and their targets, surfaces, keys of no metadata, versions.
TARGETS = {
    "impression": "recommendation_impression", "view": "post_view", "click": "recommendation_click", "like": "post_like", "unlike": "post_unlike", "save": "post_bookmark",
    "unsave": "post_unbookmark", "share": "post_share", "hide": "post_hide", "report": "post_report", "search": "search_submit", "tag_click": "tag_click",
    "follow": "follow", "unfollow": "unfollow", "crew_join": "crew_join", "crew_leave": "crew_leave",
}
SURFACES = ("home", "search", "detail", "profile", "crew")
ENTITIES = ("post", "journey", "place", "crew", "user")
SENSITIVE = (
    "accesstoken", "refreshtoken", "authorization", "password", "secret", "secretkey", "apikey", "token", "rawuserid", "userid", "accountid", "email", "phone",
    "rawquery", "query", "freetext", "rawtext", "rawcontent", "credential",
)
COMMON = ("surface", "position", "dwellTimeMs", "viewportRatio")
AUTHORITY = "recommendation_general_exposure_v1"
SCHEMA = "recommendation-behavior-event-v1"
VERSIONS = "p0-recommendation-event-adapter-v1 recommendation-p0-event-adapter-v1 recommendation-p0-mapping-policy-v1 recommendation-p0-adapter-output-sha256-v1 platform-event-v1 user-behavior-event-v1"
QUARANTINED = ("SOURCE_FINGERPRINT_MISMATCH", "PRIVACY_POLICY_VIOLATION", "TARGET_CONTRACT_VIOLATION", "ADAPTER_INVARIANT_FAILED", "EXPOSURE_AUTHORITY_CONFLICT")
# End of the fixed values.

TOGGLES = {"like": "post", "unlike": "post", "save": "post", "unsave": "post", "follow": "user", "unfollow": "user", "crew_join": "crew", "crew_leave": "crew"}
#: What a wire's payload takes from its metadata.
TAKEN = {
    "impression": ("surface", "position"), "click": ("surface", "position"), "view": ("surface",), "share": ("shareChannelClass",), "hide": ("reasonCode",),
    "report": ("reportReasonCode", "reportRef"), "search": ("searchRunRef", "queryRef", "surface"), "tag_click": ("tagRef", "surface"),
}
EVENT_REF, RUN_REF = "recommendation_behavior_event:", "recommendation_run:"


def _blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"^\s*\z")


def _first(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that holds, or null."""
    return F.coalesce(*(F.when(holds, F.lit(code)) for holds, code in rules))


def metadata_failure(metadata: Column) -> Column:
    """The failure of the first entry, in the map's order, that has one: its key's form, a sensitive key, its value's kind, length or finiteness."""

    def entry(e: Column) -> Column:
        name, v = F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", ""), e["value"]
        return _first(
            (~e["key"].rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,63}\z"), "PAYLOAD_UNMAPPABLE"),
            (name.isin(*SENSITIVE) | name.rlike("(token|password|secret|credential)$"), "PRIVACY_POLICY_VIOLATION"),
            (~F.coalesce(v["kind"].isin("text", "number", "flag"), F.lit(False)), "PAYLOAD_UNMAPPABLE"),
            ((v["kind"] == "text") & (F.length(v["text"]) > 256), "PAYLOAD_UNMAPPABLE"),
            ((v["kind"] == "number") & (F.isnan(v["number"]) | (F.abs(v["number"]) == float("inf"))), "PAYLOAD_UNMAPPABLE"),
        )

    found = F.filter(F.transform(F.map_entries(metadata), entry), lambda c: c.isNotNull())
    return F.when(F.size(metadata) > 32, "PAYLOAD_UNMAPPABLE").otherwise(F.get(found, F.lit(0)))


def source_failure() -> Column:
    """What is wrong with a source by itself; rules in order, the first one tells."""
    c = F.col
    parts = [c("entity_type"), c("entity_key"), c("entity_id")]
    none = parts[0].isNull() & parts[1].isNull() & parts[2].isNull()
    full = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    search = c("wire") == "search"
    named = F.concat(c("entity_type"), F.lit(":"), c("entity_id").cast("string"))
    return F.coalesce(
        _first(
            (c("event_ref").isNull() | ~c("event_ref").rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"), "MISSING_REQUIRED_REFERENCE"),
            (_blank(c("key")) | (F.length("key") > 160), "MISSING_REQUIRED_REFERENCE"),
            (_blank(c("session")) | (F.length("session") > 128) | _blank(c("wire")), "MISSING_REQUIRED_REFERENCE"),
            (c("body").isNull() | ~F.octet_length("body").between(1, 262_144), "SOURCE_FINGERPRINT_MISMATCH"),
            (c("body_print").isNull() | (F.sha2("body", 256) != c("body_print")), "SOURCE_FINGERPRINT_MISMATCH"),
            (c("occurred_at").isNull() | c("received_at").isNull() | (c("received_at") < c("occurred_at")), "TIMESTAMP_INVALID"),
            (c("user_id") <= 0, "IDENTITY_MAPPING_REQUIRED"),
        ),
        metadata_failure(c("metadata")),
        _first(
            (~none & ~full, "MISSING_REQUIRED_REFERENCE"),
            (search & ~none, "TARGET_CONTRACT_VIOLATION"),
            (~search & (~full | (c("entity_id") <= 0) | (c("entity_key") != named)), "MISSING_REQUIRED_REFERENCE"),
            (~search & ~c("entity_type").isin(*ENTITIES), "TARGET_CONTRACT_VIOLATION"),
        ),
    )


def _text(name: str) -> Column:
    """A metadata value that is a text, else null."""
    v = F.col("metadata")[name]
    return F.when(v["kind"] == "text", v["text"])


def mapping_failure() -> Column:
    """What keeps a sound source of a known wire from being mapped."""
    wire, type_ = F.col("wire"), F.col("entity_type")
    exposed = wire.isin("impression", "click")
    x = F.col("exposure")
    surface, position = F.col("metadata")["surface"], F.col("metadata")["position"]
    moved = (surface.isNotNull() & ~F.coalesce(_text("surface") == x["surface"], F.lit(False))) | (
        (position["kind"] == "number") & ~F.coalesce(position["number"].try_cast("long") == x["position"], F.lit(False))
    )
    wanted = F.create_map(*(F.lit(v) for kv in {**TOGGLES, "view": "post", "share": "post", "hide": "post", "report": "post"}.items() for v in kv))[wire]
    needs = lambda on, name: ((wire == on) & _blank(_text(name)), "PAYLOAD_UNMAPPABLE")
    snake = lambda on, name: ((wire == on) & (_blank(_text(name)) | ~_text(name).rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)*\z")), "PAYLOAD_UNMAPPABLE")
    foreign = lambda c: c.isNotNull() & ~c.isin(*SURFACES)
    return _first(
        (exposed & x.isNull(), "MISSING_EXPOSURE_REFERENCE"),
        (exposed & ~x["authority"].eqNullSafe(AUTHORITY), "EXPOSURE_AUTHORITY_CONFLICT"),
        (exposed & ~F.coalesce((F.col("run") == x["run"]) & (F.col("entity_key") == x["entity_key"]), F.lit(False)), "MISSING_EXPOSURE_REFERENCE"),
        (exposed & moved, "EXPOSURE_AUTHORITY_CONFLICT"),
        (exposed & ~F.coalesce(x["surface"].isin(*SURFACES), F.lit(False)), "PAYLOAD_UNMAPPABLE"),
        (wanted.isNotNull() & ~type_.eqNullSafe(wanted), "MISSING_REQUIRED_REFERENCE"),
        needs("view", "surface"),
        snake("share", "shareChannelClass"),
        snake("hide", "reasonCode"),
        snake("report", "reportReasonCode"),
        needs("search", "searchRunRef"),
        needs("search", "queryRef"),
        ((wire == "search") & foreign(_text("surface")), "PAYLOAD_UNMAPPABLE"),
        needs("tag_click", "tagRef"),
        ((wire == "tag_click") & ~_text("tagRef").rlike(r"^tag:\S{1,128}\z"), "MISSING_REQUIRED_REFERENCE"),
        needs("tag_click", "surface"),
        ((wire == "tag_click") & foreign(_text("surface")), "PAYLOAD_UNMAPPABLE"),
    )


def _payload() -> Column:
    """The target's payload as canonical JSON, keys in order; a key whose value is null isn't written."""
    wire, x = F.col("wire"), F.col("exposure")
    exposed = wire.isin("impression", "click")
    from_text = lambda on, name: F.when(wire == on, _text(name))
    fields = {
        "episodeRef": F.when(wire == "impression", x["ref"]),
        "queryRef": from_text("search", "queryRef"),
        "reasonCode": from_text("hide", "reasonCode"),
        "reportReasonCode": from_text("report", "reportReasonCode"),
        "reportRef": from_text("report", "reportRef"),
        "runRef": F.when(exposed, F.concat(F.lit(RUN_REF), x["run"])),
        "searchRunRef": from_text("search", "searchRunRef"),
        "shareChannelClass": from_text("share", "shareChannelClass"),
        "stateTransitionRef": F.when(wire.isin(*TOGGLES), F.concat(F.lit(EVENT_REF), F.col("event_ref"))),
        "surface": F.when(exposed, x["surface"]).when(wire.isin("view", "search", "tag_click"), _text("surface")),
        "tagRef": from_text("tag_click", "tagRef"),
    }
    rank = F.when(exposed, F.concat(F.lit('"absoluteRank":'), x["rank"].cast("string")))
    texts = (F.concat(F.lit(f'"{k}":'), F.when(v.isNotNull(), quoted(v))) for k, v in fields.items())
    return F.concat(F.lit("{"), F.concat_ws(",", rank, *texts), F.lit("}"))


def bind(sources: DataFrame, identities: DataFrame, exposures: DataFrame) -> DataFrame:
    """Adds subject and exposure. identities: (user_id, subject), a row per user; exposures: (entity_key, exposure), a row per entity.

    Both are left joins on one row per key; a hot user's or entity's rows are split by the adaptive plan, as they are the left side."""
    return sources.join(identities, "user_id", "left").join(exposures, "entity_key", "left")


def adapt(bound: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per source: columns to keep, status, failure, and what it was mapped to (null where it fails).

    bound: event_ref, key, session, wire, schema, body, body_print, occurred_at, received_at, user_id, run, entity_type, entity_key, entity_id,
    metadata (map of name to (kind: text, number, flag or another; text; number)), subject, exposure (ref, authority, run, entity_key, rank, position,
    surface). One projection, no shuffle. Rules go from the source itself over its schema, its wire and its subject to its mapping; the first that
    fails tells. Metadata that the target doesn't take and that isn't common are dropped and named. Lengths are in code points."""
    wire = F.col("wire")
    target = F.create_map(*(F.lit(v) for kv in TARGETS.items() for v in kv))[wire]
    failure = F.coalesce(
        source_failure(),
        _first(
            (~F.col("schema").eqNullSafe(SCHEMA), "UNSUPPORTED_SCHEMA_VERSION"),
            (target.isNull(), "UNSUPPORTED_EVENT_TYPE"),
            (F.col("user_id").isNull() | F.col("subject").isNull(), "IDENTITY_MAPPING_REQUIRED"),
        ),
        mapping_failure(),
    )
    taken = F.create_map(*(v for k, names in TAKEN.items() for v in (F.lit(k), F.array(*map(F.lit, names)))))[wire]
    spare = F.array_except(F.array_except(F.map_keys("metadata"), F.array(*map(F.lit, COMMON))), F.coalesce(taken, F.array().cast("array<string>")))
    rows = bound.select("*", failure.alias("failure"), target.alias("_target"))
    ok = F.col("failure").isNull()
    mapped = rows.select(
        *keep,
        "event_ref",
        F.when(ok, "MAPPED_SHADOW").when(F.col("failure").isin(*QUARANTINED), "QUARANTINED").otherwise("UNSUPPORTED").alias("status"),
        "failure",
        F.when(ok, F.col("_target")).alias("target"),
        F.when(ok, F.col("subject")).alias("actor"),
        F.when(ok, F.concat(F.lit("session:p0-"), F.sha2("session", 256))).alias("session_ref"),
        F.when(ok, F.when(wire == "tag_click", _text("tagRef")).otherwise(F.col("entity_key"))).alias("entity"),
        F.when(ok, F.concat(F.lit(RUN_REF), F.col("run"))).alias("run_ref"),
        F.when(ok & wire.isin("impression", "click"), F.col("exposure")["ref"]).alias("authority"),
        F.when(ok, _payload()).alias("payload"),
        F.when(ok, F.coalesce(F.array_join(F.array_sort(spare), ","), F.lit(""))).alias("dropped"),
        F.unix_micros("occurred_at").alias("_at"),
        "body_print",
    )
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("event_ref", "body_print", "target", "_at", "actor", "session_ref", "entity", "run_ref", "authority", "payload")]
    return mapped.withColumn("output_print", F.when(F.col("status") == "MAPPED_SHADOW", F.sha2(F.concat_ws("\n", F.lit(VERSIONS), *shown), 256))).drop("_at", "body_print")


#: Wires by kind and event_id % 4; "boost" is none.
_WIRES = {
    "view": ("impression", "view", "search", "crew_leave"), "click": ("click", "like", "unlike", "share"), "save": ("save", "unsave", "hide", "crew_join"),
    "follow": ("follow", "unfollow", "tag_click", "boost"), "report": ("report", "impression", "view", "click"),
}
_N = "event_id"
#: Stand-ins as expressions that both engines read: behaviour with defects at some multiples.
_FIELDS = {
    "event_ref": f"CASE WHEN {_N} % 101 = 0 THEN concat('!', {_N}) ELSE concat('e', {_N}) END",
    "key": f"CASE WHEN {_N} % 103 = 0 THEN '  ' ELSE concat('k', {_N}) END",
    "session": f"CASE WHEN {_N} % 107 = 0 THEN repeat('s', 129) ELSE concat('s', user_id, '-', {_N} % 7) END",
    "wire": f"CASE WHEN {_N} % 109 = 0 THEN ' ' ELSE wire0 END",
    "schema": f"CASE WHEN {_N} % 163 = 0 THEN 'recommendation-behavior-event-v2' ELSE '{SCHEMA}' END",
    "body": f"CASE WHEN {_N} % 127 = 0 THEN '' ELSE concat(kind, '|', {_N}, '|', post_id) END",
    "run": f"CASE WHEN {_N} % 31 = 0 THEN 'r-other' ELSE concat('r', post_id % 50) END",
    "entity_type": f"CASE WHEN wire0 = 'search' AND {_N} % 7 <> 3 THEN NULL WHEN {_N} % 151 = 0 THEN 'planet' WHEN {_N} % 23 = 0 THEN 'place' WHEN wire0 IN ('follow', 'unfollow') THEN 'user' WHEN wire0 IN ('crew_join', 'crew_leave') THEN 'crew' ELSE 'post' END",
    "surface": f"CASE WHEN {_N} % 19 = 0 THEN NULL WHEN {_N} % 17 = 0 THEN 'moon' WHEN wire0 IN ('impression', 'click') THEN shown ELSE 'detail' END",
    "position": f"CASE WHEN wire0 IN ('impression', 'click') THEN CASE WHEN {_N} % 29 = 0 THEN -1 ELSE post_id % 20 END END",
    "share": f"CASE WHEN wire0 = 'share' THEN CASE WHEN {_N} % 6 = 1 THEN 'Direct' ELSE 'direct_link' END END",
    "hide": f"CASE WHEN wire0 = 'hide' AND {_N} % 6 <> 0 THEN 'seen_before' END",
    "reason": f"CASE WHEN wire0 = 'report' THEN CASE WHEN {_N} % 6 = 0 THEN 'spam_' ELSE 'spam' END END",
    "report_ref": f"CASE WHEN wire0 = 'report' AND {_N} % 3 = 1 THEN concat('report:', {_N}) END",
    "search_run": f"CASE WHEN wire0 = 'search' THEN concat('sr', {_N}) END",
    "query_ref": f"CASE WHEN wire0 = 'search' AND {_N} % 5 <> 0 THEN concat('q', post_id) END",
    "tag": f"CASE WHEN wire0 = 'tag_click' THEN CASE WHEN {_N} % 6 = 0 THEN 'tag:' WHEN {_N} % 10 = 0 THEN 'post:1' ELSE concat('tag:', post_id) END END",
    "extra": f"CASE {_N} % 41 WHEN 0 THEN 'access_Token' WHEN 1 THEN '-bad' WHEN 2 THEN 'nested' WHEN 3 THEN 'note' WHEN 4 THEN 'ratio' WHEN 5 THEN 'dwellTimeMs' WHEN 6 THEN 'campaign' WHEN 7 THEN 'abtest' END",
}
_SHOWN = "CASE post_id % 6 WHEN 0 THEN 'home' WHEN 1 THEN 'search' WHEN 2 THEN 'detail' WHEN 3 THEN 'profile' WHEN 4 THEN 'crew' ELSE 'attic' END"
_WIRE0 = "CASE kind " + " ".join(f"WHEN '{k}' THEN CASE {_N} % 4 WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' WHEN 2 THEN '{c}' ELSE '{e}' END" for k, (a, b, c, e) in _WIRES.items()) + " END"
_TEXTS = {"surface": "surface", "shareChannelClass": "share", "reasonCode": "hide", "reportReasonCode": "reason", "reportRef": "report_ref", "searchRunRef": "search_run", "queryRef": "query_ref", "tagRef": "tag"}


def wire_sources(d: Domain) -> DataFrame:
    rows = d.behaviour.withColumns({"shown": F.expr(_SHOWN), "wire0": F.expr(_WIRE0)})
    rows = rows.withColumns({k: F.expr(v) for k, v in _FIELDS.items()})
    value = lambda kind, text=None, number=None: F.struct(F.lit(kind).alias("kind"), F.lit(text).cast("string").alias("text"), F.lit(number).cast("double").alias("number"))
    entry = lambda name, v: F.struct(name.alias("key"), v.alias("value"))
    n, extra = F.col(_N), F.col("extra")
    odd = F.when(n % 41 == 2, value("list")).when(n % 41 == 3, value("text", F.repeat(F.lit("n"), 257))).when(n % 41 == 4, value("number", None, float("inf"))).when(n % 41 == 5, value("number", None, 5.0)).otherwise(value("text", "x"))
    entries = [F.when(F.col(c).isNotNull(), entry(F.lit(k), value("text", F.col(c)))) for k, c in _TEXTS.items()]
    entries += [F.when(F.col("position").isNotNull(), entry(F.lit("position"), value("number", None, F.col("position")))), F.when(extra.isNotNull(), entry(extra, odd))]
    entity_id = F.when(F.col("entity_type").isNotNull() & (n % 139 != 0), F.col("post_id"))
    return rows.select(
        n, "event_ref", "key", "session", "wire", "schema", "body", F.when(n % 113 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("body", 256)).alias("body_print"), F.col("ts").alias("occurred_at"),
        (F.col("ts") + F.when(n % 131 == 0, F.expr("INTERVAL -1 SECOND")).otherwise(F.expr("INTERVAL 1 SECOND"))).alias("received_at"), "user_id", "run", "entity_type",
        F.concat("entity_type", F.lit(":"), (F.col("post_id") + (n % 149 == 0).cast("int")).cast("string")).alias("entity_key"), entity_id.alias("entity_id"),
        F.map_from_entries(F.array_compact(F.array(*entries))).alias("metadata"),
    )


def wire_exposures(d: Domain) -> DataFrame:
    """One exposure per post, but for every ninth."""
    p = d.posts.filter("post_id % 9 <> 8")
    part = lambda x, name: F.expr(x).alias(name)
    authority = f"CASE WHEN post_id % 13 = 0 THEN 'recommendation_p2_experiment_exposure_v1' ELSE '{AUTHORITY}' END"
    exposure = F.struct(part("concat('exposure:', post_id)", "ref"), part(authority, "authority"), part("concat('r', post_id % 50)", "run"), part("concat('post:', post_id)", "entity_key"), part("size", "rank"), part("post_id % 20", "position"), part(_SHOWN, "surface"))
    return p.select(part("concat('post:', post_id)", "entity_key"), exposure.alias("exposure"))


_EXPOSED = "wire IN ('impression', 'click')"
_SQL = f"""WITH b AS (SELECT *, {_SHOWN} AS shown, {_WIRE0} AS wire0 FROM behaviour),
    f AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _FIELDS.items())} FROM b),
    g AS (SELECT f.*, sha256(body) AS good, CASE WHEN entity_type IS NOT NULL THEN entity_type || ':' || (post_id + CASE WHEN event_id % 149 = 0 THEN 1 ELSE 0 END) END AS entity_key, CASE WHEN entity_type IS NOT NULL AND event_id % 139 <> 0 THEN post_id END AS entity_id FROM f),
    x AS (SELECT 'exposure:' || post_id AS x_ref, post_id % 13 = 0 AS x_odd, 'r' || (post_id % 50) AS x_run, 'post:' || post_id AS x_key, size AS x_rank, post_id % 20 AS x_position, {_SHOWN} AS x_surface FROM posts WHERE post_id % 9 <> 8),
    j AS (SELECT g.*, x.*, CASE WHEN m.user_id IS NOT NULL THEN 'subject:' || m.user_id END AS subject FROM g LEFT JOIN x ON entity_key = x_key LEFT JOIN members m ON m.user_id = g.user_id AND m.active),
    r AS (SELECT *, CASE WHEN event_id % 101 = 0 OR event_id % 103 = 0 OR event_id % 107 = 0 OR event_id % 109 = 0 THEN 'MISSING_REQUIRED_REFERENCE'
        WHEN event_id % 127 = 0 OR event_id % 113 = 0 THEN 'SOURCE_FINGERPRINT_MISMATCH' WHEN event_id % 131 = 0 THEN 'TIMESTAMP_INVALID' WHEN user_id <= 0 THEN 'IDENTITY_MAPPING_REQUIRED'
        WHEN event_id % 41 = 0 THEN 'PRIVACY_POLICY_VIOLATION' WHEN event_id % 41 IN (1, 2, 3, 4) THEN 'PAYLOAD_UNMAPPABLE'
        WHEN entity_type IS NOT NULL AND (event_id % 139 = 0) THEN 'MISSING_REQUIRED_REFERENCE' WHEN wire = 'search' AND entity_type IS NOT NULL THEN 'TARGET_CONTRACT_VIOLATION'
        WHEN wire <> 'search' AND (post_id <= 0 OR event_id % 149 = 0) THEN 'MISSING_REQUIRED_REFERENCE' WHEN wire <> 'search' AND entity_type = 'planet' THEN 'TARGET_CONTRACT_VIOLATION'
        WHEN event_id % 163 = 0 THEN 'UNSUPPORTED_SCHEMA_VERSION' WHEN wire = 'boost' THEN 'UNSUPPORTED_EVENT_TYPE' WHEN subject IS NULL THEN 'IDENTITY_MAPPING_REQUIRED'
        WHEN {_EXPOSED} AND x_ref IS NULL THEN 'MISSING_EXPOSURE_REFERENCE' WHEN {_EXPOSED} AND x_odd THEN 'EXPOSURE_AUTHORITY_CONFLICT' WHEN {_EXPOSED} AND run <> x_run THEN 'MISSING_EXPOSURE_REFERENCE'
        WHEN {_EXPOSED} AND (surface <> x_surface OR position <> x_position) THEN 'EXPOSURE_AUTHORITY_CONFLICT' WHEN {_EXPOSED} AND x_surface NOT IN {SURFACES} THEN 'PAYLOAD_UNMAPPABLE'
        WHEN wire IN ('view', 'like', 'unlike', 'save', 'unsave', 'share', 'hide', 'report') AND entity_type <> 'post' OR wire IN ('follow', 'unfollow') AND entity_type <> 'user' OR wire IN ('crew_join', 'crew_leave') AND entity_type <> 'crew' THEN 'MISSING_REQUIRED_REFERENCE'
        WHEN wire = 'view' AND surface IS NULL OR wire = 'share' AND share = 'Direct' OR wire = 'hide' AND hide IS NULL OR wire = 'report' AND reason = 'spam_' OR wire = 'search' AND (query_ref IS NULL OR surface = 'moon') THEN 'PAYLOAD_UNMAPPABLE'
        WHEN wire = 'tag_click' AND (tag = 'tag:' OR tag = 'post:1') THEN 'MISSING_REQUIRED_REFERENCE' WHEN wire = 'tag_click' AND (surface IS NULL OR surface = 'moon') THEN 'PAYLOAD_UNMAPPABLE' END AS failure FROM j),
    o AS (SELECT *, failure IS NULL AS ok, CASE wire {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TARGETS.items())} END AS to_type,
        '{{' || concat_ws(',', CASE WHEN {_EXPOSED} THEN '"absoluteRank":' || x_rank END, CASE WHEN wire = 'impression' THEN '"episodeRef":"' || x_ref || '"' END, '"queryRef":"' || query_ref || '"', '"reasonCode":"' || hide || '"', '"reportReasonCode":"' || reason || '"',
        '"reportRef":"' || report_ref || '"', CASE WHEN {_EXPOSED} THEN '"runRef":"{RUN_REF}' || x_run || '"' END, '"searchRunRef":"' || search_run || '"', '"shareChannelClass":"' || share || '"',
        CASE WHEN wire IN {tuple(TOGGLES)} THEN '"stateTransitionRef":"{EVENT_REF}' || event_ref || '"' END, CASE WHEN {_EXPOSED} THEN '"surface":"' || x_surface || '"' WHEN wire IN ('view', 'search', 'tag_click') THEN '"surface":"' || surface || '"' END, '"tagRef":"' || tag || '"') || '}}' AS body_out FROM r),
    q AS (SELECT event_id, event_ref, CASE WHEN ok THEN 'MAPPED_SHADOW' WHEN failure IN {QUARANTINED} THEN 'QUARANTINED' ELSE 'UNSUPPORTED' END AS status, failure, CASE WHEN ok THEN to_type END AS target, CASE WHEN ok THEN subject END AS actor, CASE WHEN ok THEN 'session:p0-' || sha256(session) END AS session_ref,
        CASE WHEN ok THEN CASE WHEN wire = 'tag_click' THEN tag ELSE entity_key END END AS entity, CASE WHEN ok THEN '{RUN_REF}' || run END AS run_ref, CASE WHEN ok AND {_EXPOSED} THEN x_ref END AS authority, CASE WHEN ok THEN body_out END AS payload,
        CASE WHEN ok THEN CASE WHEN extra IN ('campaign', 'abtest') THEN extra ELSE '' END END AS dropped, epoch_us(ts) AS micros, good FROM o)
    SELECT * EXCLUDE (micros, good), CASE WHEN status = 'MAPPED_SHADOW' THEN sha256(concat_ws(chr(10), '{VERSIONS}', event_ref, good, target, micros::VARCHAR, actor, session_ref, coalesce(entity, '-'), coalesce(run_ref, '-'), coalesce(authority, '-'), payload)) END AS output_print FROM q"""


@query("behaviour_mapping", _SQL, ("behaviour", "posts", "members"))
def behaviour_mapping(d: Domain) -> DataFrame:
    """Behaviour as wire events, mapped or told why not."""
    identities = d.members.filter("active").select("user_id", F.concat(F.lit("subject:"), F.col("user_id").cast("string")).alias("subject"))
    bound = bind(wire_sources(d), identities, wire_exposures(d))
    return adapt(bound, keep=("event_id",))
