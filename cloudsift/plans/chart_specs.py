"""The charts of the dashboards as data: 244 specs over the datasets, in five catalogues.

A line is: name | shape | dataset | dimensions | measures | condition | rows | order. Dimensions are columns or
names of DIMENSIONS, measures are names of MEASURES or of the dataset's own list (`a=b`: b under the name a). A condition is SQL, or after
an @ services with actions (`ec2: A B; iam: C`; a star stands for any service). The order is that of the first measure, falling, unless one
is named; `asc` has the least first. Charts are numbered by name within their catalogue.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Columns of most tables of events.
EVENT = "event_time event_name user_identity_arn aws_region source_ip_address geo_country_code geo_city error_code"
SERVICE = "event_time event_name event_source user_identity_arn aws_region source_ip_address geo_country_code geo_city error_code"
CALL = "event_time user_identity_arn aws_region source_ip_address geo_country_code geo_city error_code"
CALLER = "user_identity_arn source_ip_address geo_country_code geo_city"

# What the dashboards call their dimensions and measures, and what these are. json, span, secs, matches,
# five, clock_hour and clock_day stand for functions that engines name differently.
DIMENSIONS = {
    "hour_utc": "clock_hour(time)", "day_of_week": "CASE clock_day(time) WHEN 0 THEN '0_Sun' WHEN 1 THEN '1_Mon' WHEN 2 THEN '2_Tue' WHEN 3 THEN '3_Wed' WHEN 4 THEN '4_Thu' WHEN 5 THEN '5_Fri' WHEN 6 THEN '6_Sat' END",
    "hour_bucket": "date_trunc('hour', event_time)",
    "cedar_mode": "json(request_parameters, policyEngineConfiguration.cedarConfiguration.mode)", "gateway_id": "json(request_parameters, gatewayIdentifier)",
    "destination_bucket": "json(request_parameters, bucketName)", "bucket_name": "json(request_parameters, bucketName)", "object_key": "json(request_parameters, key)",
    "copy_source": "coalesce(json(request_parameters, 'x-amz-copy-source'), json(request_parameters, copySource))", "to_role": "json(request_parameters, roleArn)",
    "federated_provider": "json(additional_event_data, federatedProvider)",
    "changed_value": "coalesce(json(request_parameters, attributes.MonthlySpendLimit), json(request_parameters, attributes.DefaultSenderID), json(request_parameters, enabled), json(request_parameters, sendingEnabled), json(request_parameters, phoneNumber))",
    "encryption": "CASE encryption_status WHEN 0 THEN 'Not encrypted' WHEN 1 THEN 'Nitro-encrypted' WHEN 2 THEN 'Application-encrypted' WHEN 3 THEN 'Nitro + application' END",
}
FAILED_LOGIN = "json(response_elements, ConsoleLogin) = 'Failure' OR json(additional_event_data, success) = 'false'"
GOOD_LOGIN = "json(response_elements, ConsoleLogin) = 'Success' OR json(additional_event_data, success) = 'true'"
WRITES = "count(*) FILTER (WHERE read_only IS NOT TRUE)"
PEOPLE = "count(DISTINCT coalesce(user_arn, user_name))"
#: Measures that are the number of rows under another name.
ROWS = (
    "denied_count changes token_requests event_count total_calls failed_calls invocation_count total_logins copies read_calls total_events error_events error_count logins request_count login_count posture_probe_count grants notes hops "
    "call_count run_instances delete_count get_object_count send_enablement_events api_calls throttle_count events_per_hour creation_events detections records identities identity_count observations_seen rejected_records syn_only_records skipdata_windows"
).split()
MEASURES = {
    **dict.fromkeys(ROWS, "count(*)"),
    "first_seen": "min(event_time)", "last_seen": "max(event_time)", "first_access": "min(event_time)", "last_access": "max(event_time)",
    "failure_count": f"count(*) FILTER (WHERE {FAILED_LOGIN})", "failed_logins": f"count(*) FILTER (WHERE {FAILED_LOGIN})", "success_count": f"count(*) FILTER (WHERE {GOOD_LOGIN})", "success_logins": f"count(*) FILTER (WHERE {GOOD_LOGIN})",
    "mfa_less_count": "count(*) FILTER (WHERE json(additional_event_data, MFAUsed) = 'No')", "mfa_less_logins": "count(*) FILTER (WHERE json(additional_event_data, MFAUsed) = 'No')", "mfa_logins": "count(*) FILTER (WHERE json(additional_event_data, MFAUsed) = 'Yes')",
    "distinct_models": "count(DISTINCT json(request_parameters, modelId))", "models_tried": "count(DISTINCT json(request_parameters, modelId))", "distinct_buckets": "count(DISTINCT json(request_parameters, bucketName))",
    # Counted, not estimated.
    "approx_distinct_objects": "count(DISTINCT json(request_parameters, key))",
    "regions_tried": "count(DISTINCT aws_region)", "regions_used": "count(DISTINCT aws_region)", "distinct_regions": "count(DISTINCT aws_region)", "active_regions": "count(DISTINCT aws_region)",
    "active_span_days": "span(day, min(event_time), max(event_time))", "active_span_minutes": "span(minute, min(event_time), max(event_time))",
    "read_events": "count(*) FILTER (WHERE read_only IS TRUE)", "read_only_calls": "count(*) FILTER (WHERE read_only IS TRUE)", **dict.fromkeys(("write_events", "write_count", "write_requests", "write_calls"), WRITES),
    "write_ratio_pct": f"round({WRITES} * 100.0 / nullif(count(*), 0), 1)", "failed_events": "count(error_code)", "error_requests": "count(error_code)",
    **dict.fromkeys(("unique_callers", "unique_identities", "distinct_callers", "distinct_identities", "distinct_principals", "affected_principals"), "count(DISTINCT user_identity_arn)"),
    "distinct_source_ips": "count(DISTINCT source_ip_address)", "distinct_ips": "count(DISTINCT source_ip_address)", "distinct_apis": "count(DISTINCT event_name)", "distinct_operations": "count(DISTINCT event_name)", "distinct_countries": "count(DISTINCT geo_country_code)",
}
SEEN = {"first_seen": "min(first_seen)", "last_seen": "max(last_seen)"}
CALLS = "sum(call_count)"
#: Measures that a dataset has instead.
OWN = {
    "detection_metrics": {"occurrences": "sum(occurrence_count)", **SEEN, "countries": "count(DISTINCT src_country)", "fields": "count(DISTINCT field)", "values": "count(DISTINCT value)", "singletons": "count(CASE WHEN occurrence_count = 1 THEN 1 END)", "top_share": "max(percent)", "share_pct": "max(percent)", "active_days": "max(active_days)", "newest": "max(first_seen)"},
    "provenance": {"files_scanned": "max(scanned_files)", "events_scanned": "max(scanned_events)", "rows_written": "max(output_rows)", "rules_loaded": "max(rules_count)", "detections_written": "max(output_rows)", "duplicates_removed": "max(duplicate_rows_removed)"},
    "api_calls": {"calls": CALLS, "failed_calls": CALLS, "failed_abuse": CALLS, **SEEN, "identities": "count(DISTINCT user_arn)", "success": "sum(CASE WHEN outcome = 'success' THEN call_count ELSE 0 END)", "failed": "sum(CASE WHEN outcome = 'failed' THEN call_count ELSE 0 END)", "abused_apis": "count(DISTINCT api)"},
    "attributes": {"occurrences": "sum(occurrence_count)", **SEEN, "identities": "count(DISTINCT user_arn)", "access_keys": "count(DISTINCT value)", "source_ips": "count(DISTINCT value)"},
    "identities": {
        "events": "sum(num_of_events)", "total_events": "sum(num_of_events)", "abused_success": "sum(abused_success)", "abused_failed": "sum(abused_failed)", "other": "sum(other_success) + sum(other_failed)", "abused": "sum(abused_success) + sum(abused_failed)", "abused_apis": "sum(abused_apis)", **SEEN,
        "active_days": "max(active_days)", "source_ips": "sum(distinct_src_ips)", "user_agents": "sum(distinct_user_agents)", "access_keys": "sum(distinct_access_keys)", "regions": "sum(distinct_regions)",
    },
    "timeline": {
        "distinct_rules": "count(DISTINCT rule_title)", "distinct_ips": "count(DISTINCT src_ip)", "distinct_principals": PEOPLE, "max_severity_rank": "max(level_rank)", "severity_rank": "max(level_rank)", "active_days": "count(DISTINCT CAST(event_time AS DATE))",
        "critical_high": "count(*) FILTER (WHERE level_rank >= 4)", "distinct_accounts": "count(DISTINCT user_account_id)", "distinct_events": "count(DISTINCT event_id)", "distinct_actions": "count(DISTINCT event_name)",
    },
    "timeline_tags": {"detections": "count(DISTINCT event_id)", "distinct_rules": "count(DISTINCT rule_title)", "distinct_tactics": "count(DISTINCT CASE WHEN tag_type = 'tactic' THEN tag_value END)", "distinct_techniques": "count(DISTINCT CASE WHEN tag_type = 'technique' THEN tag_value END)"},
    "flow_records": {
        "bytes_measured": "sum(bytes_measured)", "first_seen": "min(start_time)", "last_seen": "max(start_time)", "observations": "count(*)", "observing_interfaces": "count(DISTINCT interface_id)", "interfaces": "count(DISTINCT interface_id)", "external_peers": "count(DISTINCT remote_addr)",
        **{f"{n}_share": f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)" for n, c in {"recorded_direction": "direction_source = 'record'", "packet_address": "pkt_srcaddr IS NOT NULL", "tcp_flags": "tcp_flags IS NOT NULL", "bytes": "bytes_measured IS NOT NULL", "traffic_path": "traffic_path_label IS NOT NULL", "encryption_status": "encryption_status IS NOT NULL"}.items()},
        "observed_windows": "count(DISTINCT date_trunc('minute', start_time))", "span_hours": "(secs(max(end_time)) - secs(min(start_time))) / 3600.0", "bytes_per_second": "sum(bytes_measured) / nullif(secs(max(end_time)) - secs(min(start_time)), 0)",
        "destinations": "count(DISTINCT remote_addr)", "external_asns": "count(DISTINCT remote_geo_asn)", "inbound_countries": "count(DISTINCT remote_geo_country_code)", "outbound_countries": "count(DISTINCT remote_geo_country_code)", "reject_ratio": "avg(CASE WHEN action = 'REJECT' THEN 1.0 ELSE 0.0 END)",
        "distinct_internal_peers": "count(DISTINCT flow_dst)", "distinct_external_peers": "count(DISTINCT flow_dst)", "distinct_targets": "count(DISTINCT local_addr)", "distinct_ports": "count(DISTINCT dstport)",
    },
    "flow_log_configs": {"recorded_at": "min(event_time)"},
    "flow_sources": {**{c: f"sum({c})" for c in "files rows_total rows_with_issues rows_rejected nodata_rows skipdata_rows".split()}, "interfaces_seen": "max(interfaces_seen)", "header_variants": "max(header_variants)", "first_observation": "min(first_observation)", "last_observation": "max(last_observation)"},
    "flow_egress_daily": {"egress_bytes": "sum(egress_bytes)", **{c: f"max({c})" for c in "ratio_to_baseline baseline_bytes baseline_days remote_peers".split()}},
    "flow_internal_pairs": {"first_seen": "min(first_seen)", "observations": "sum(observations)", "bytes_measured": "sum(bytes_measured)"},
    "flow_staging": {"internal_in_bytes": "sum(internal_in_bytes)", "external_out_bytes": "sum(external_out_bytes)", "first_internal_in": "min(first_internal_in)", "last_external_out": "max(last_external_out)", "external_peers": "max(external_peers)"},
    "flow_periodicity": {c: f"max({c})" for c in "period_secs active_buckets jitter active_bucket_ratio bytes_cv skipdata_overlaps span_hours".split()},
    "flow_reject_accept": {"rejects": "sum(rejects)", "accepts": "sum(accepts)", "first_reject": "min(first_reject)", "last_accept": "max(last_accept)"},
}
#: Measures that are times.
TIMES = {"first_seen", "last_seen", "first_access", "last_access", "newest", "recorded_at", "first_observation", "last_observation", "first_internal_in", "last_external_out", "first_reject", "last_accept"}

OUT, IN, PUBLIC = "direction_source = 'record' AND flow_direction = 'egress'", "direction_source = 'record' AND flow_direction = 'ingress'", "remote_scope = 'public'"
PLACE = "remote_geo_country_code IS NOT NULL AND remote_geo_country_code NOT IN ('PRIVATE', 'LOOPBACK', 'LINK-LOCAL', 'SPECIAL')"
INSIDE = "log_status = 'OK' AND src_scope = 'private' AND dst_scope = 'private'"
# Lists of actions that several charts share.
LOGIN = "@signin: ConsoleLogin CreateOAuth2Token AuthorizeOAuth2Access"
INVOKE = "@bedrock: InvokeModel InvokeModelWithResponseStream Converse ConverseStream"
RISKY = (
    "@*: AssumeRole AssumeRoleWithWebIdentity AttachUserPolicy CreateAccessKey CreateFunction CreateInstanceProfile CreateLoginProfile CreatePolicy CreateRole CreateUser DeletePolicy DeleteTrail DescribeInstances DescribeVpcs DetachPolicy GetAccessKeyLastUsed GetBucketAcl "
    "GetAccountAuthorizationDetails GetBucketPolicy GetCallerIdentity GetParameter GetParameterHistory GetSecretValue InvokeFunction ListAccessKeys ListAttachedUserPolicies ListBuckets ListGroups ListParameters ListRoles ListSecrets ListUsers PutBucketPolicy PutEventSelectors "
    "PutRolePolicy PutUserPolicy RunInstances SendCommand StartInstances StartSession StopLogging UpdateAssumeRolePolicy UpdateTrail"
)
TAMPERING = (
    "StopLogging DeleteTrail UpdateTrail PutEventSelectors PutInsightSelectors DeleteDetector DeletePublishingDestination CreateFilter UpdateFilter DeleteConfigRule StopConfigurationRecorder DeleteDeliveryChannel DeleteFlowLogs DeleteLogGroup DeleteLogStream PutRetentionPolicy DisableSecurityHub DeleteAnalyzer"
)
DETECTOR_OFF = "event_name = 'UpdateDetector' AND request_parameters LIKE '%\"enable\":false%'"
ALARMS = "StopLogging DeleteTrail PutEventSelectors PutInsightSelectors DeleteDetector DisableSecurityHub StopConfigurationRecorder DeleteBackupVault ScheduleKeyDeletion RegisterDelegatedAdministrator AssumeRoot"
ESCALATION = "CreateAccessKey CreateLoginProfile UpdateLoginProfile AttachUserPolicy AttachRolePolicy PutUserPolicy PutRolePolicy UpdateAssumeRolePolicy AddUserToGroup CreateSAMLProvider UpdateSAMLProvider CreateOpenIDConnectProvider CreatePermissionSet CreateAccountAssignment"
FOREIGN = "recipient_account_id IS NOT NULL AND user_identity_account_id IS NOT NULL AND recipient_account_id <> user_identity_account_id"

# Names, dimensions, measures, conditions and row limits of the charts.
METRICS_CHARTS = """
geo_value_matrix | top | detection_metrics | value src_country src_city src_asn | occurrences first_seen | src_country IS NOT NULL | 200
kpi_distinct_countries | kpi | detection_metrics | | countries
kpi_distinct_fields | kpi | detection_metrics | | fields
kpi_distinct_values | kpi | detection_metrics | | values
kpi_singleton_values | kpi | detection_metrics | | singletons
kpi_top_share | kpi | detection_metrics | | top_share
kpi_total_occurrences | kpi | detection_metrics | | occurrences
newest_values | top | detection_metrics | value | first_seen last_seen occurrences | | 25 | newest
rare_values | top | detection_metrics | value | occurrences first_seen last_seen | | 200 | asc
run_info | top | provenance | source_file command command_line tool_version timestamp_tz | files_scanned events_scanned rows_written | | 10
top_asns | top | detection_metrics | src_asn | occurrences | src_country IS NOT NULL | 25
top_countries | top | detection_metrics | src_country | occurrences | src_country IS NOT NULL | 25
top_values | top | detection_metrics | value | occurrences | | 25
value_frequency_table | top | detection_metrics | value | occurrences share_pct first_seen last_seen active_days | | 200
value_share_composition | pie | detection_metrics | value | occurrences | | 15
"""
SUMMARY_CHARTS = """
abused_api_catalogue | top | api_calls | api event_source description | calls identities first_seen last_seen | is_abused | 200
abused_apis_by_service | top | api_calls | event_source | success failed | is_abused | 20
abused_vs_other_per_identity | top | identities | user_arn | abused_success abused_failed other | | 15
attribute_first_last_seen | top | attributes | attribute value | first_seen last_seen occurrences identities | | 200
identity_activity_span | top | identities | user_arn | first_seen last_seen active_days source_ips user_agents access_keys regions | | 200 | active_days
identity_triage | top | identities | user_arn user_types | events abused_success abused_failed abused_apis first_seen last_seen | | 200 | abused
identity_type_composition | pie | identities | user_types | identities | | 25
kpi_abused_apis | kpi | api_calls | | abused_apis | is_abused
kpi_access_keys | kpi | attributes | | access_keys | attribute = 'UserAccessKeyID'
kpi_failed_abuse | kpi | api_calls | | failed_abuse | is_abused AND outcome = 'failed'
kpi_identities | kpi | identities | | identity_count
kpi_source_ips | kpi | attributes | | source_ips | attribute = 'SrcIP'
kpi_total_events | kpi | identities | | total_events
rare_attribute_values | top | attributes | attribute value user_arn | occurrences first_seen last_seen | | 200 | asc
run_info | top | provenance | source_file command command_line tool_version timestamp_tz | files_scanned events_scanned rows_written | | 10
top_abused_apis | top | api_calls | api | calls | is_abused | 20
top_attribute_values | top | attributes | value | occurrences | | 25
top_failed_apis | top | api_calls | api | failed_calls | outcome = 'failed' | 20
top_identities_by_events | top | identities | user_arn | events | | 20
"""
TIMELINE_CHARTS = """
access_key_activity | top | timeline | user_access_key_id user_name user_account_id | detections distinct_rules distinct_ips last_seen | user_access_key_id IS NOT NULL | 100
account_activity | top | timeline | user_account_id | detections max_severity_rank distinct_principals distinct_rules first_seen last_seen | user_account_id IS NOT NULL | 100
detection_bursts | series PT5M | timeline | | detections distinct_rules | | 10000
detection_detail | top | timeline | event_time level rule_title event_name event_source user_name user_type src_ip aws_region outcome error_code event_id | severity_rank | | 2000
detection_heatmap | heatmap | timeline | hour_utc day_of_week | detections | | 10000
detections_over_time | series PT1H | timeline | level | detections | | 10000
error_code_breakdown | top | timeline | error_code | detections distinct_principals | error_code IS NOT NULL | 25
event_rule_matrix | top | timeline | event_name rule_title level outcome | detections distinct_principals last_seen | event_name IS NOT NULL | 500
event_source_breakdown | top | timeline | event_source | detections max_severity_rank | event_source IS NOT NULL | 25
identity_type_breakdown | top | timeline | user_type | detections distinct_principals max_severity_rank | user_type IS NOT NULL | 20
kpi_active_days | kpi | timeline | | active_days
kpi_critical_high | kpi | timeline | | critical_high
kpi_distinct_accounts | kpi | timeline | | distinct_accounts
kpi_distinct_events | kpi | timeline | | distinct_events
kpi_distinct_principals | kpi | timeline | | distinct_principals
kpi_distinct_rules | kpi | timeline | | distinct_rules
kpi_distinct_source_ips | kpi | timeline | | distinct_ips
kpi_distinct_tactics | kpi | timeline_tags | | distinct_tactics
kpi_distinct_techniques | kpi | timeline_tags | | distinct_techniques
kpi_total_detections | kpi | timeline | | detections
mitre_tactic_by_principal | heatmap | timeline_tags | tag_value user_name | detections | tag_type = 'tactic' AND user_name IS NOT NULL | 10000
mitre_tactic_distribution | top | timeline_tags | tag_value | detections distinct_rules | tag_type = 'tactic' | 20
mitre_tactic_over_time | series P1D | timeline_tags | tag_value | detections | tag_type = 'tactic' | 10000
mitre_tactic_severity | heatmap | timeline_tags | level tag_value | detections | tag_type = 'tactic' | 10000
mitre_technique_distribution | top | timeline_tags | tag_value | detections distinct_rules | tag_type = 'technique' | 30
mitre_technique_rules | top | timeline_tags | tag_value rule_title level | detections first_seen last_seen | tag_type = 'technique' | 250
mitre_threat_groups | top | timeline_tags | tag_value rule_title user_name | detections first_seen last_seen | tag_type = 'group' | 100
newly_firing_rules | top | timeline | rule_title level | first_seen last_seen detections active_span_minutes | | 250
outcome_breakdown | top | timeline | outcome level | detections distinct_rules | outcome IS NOT NULL | 20
principal_rule_matrix | top | timeline | user_name rule_title level | detections first_seen last_seen | | 500
principal_summary | top | timeline | user_name user_type user_account_id | detections max_severity_rank distinct_rules distinct_ips first_seen last_seen active_span_minutes | user_name IS NOT NULL OR user_arn IS NOT NULL | 250
rare_rules | top | timeline | rule_title level | detections first_seen last_seen | | 25 | asc
rare_user_agents | top | timeline | user_agent user_name | detections first_seen last_seen | user_agent IS NOT NULL | 25 | asc
region_activity | top | timeline | aws_region | detections distinct_rules max_severity_rank | aws_region IS NOT NULL | 30
rule_catalog | top | timeline | rule_id rule_title level rule_author tactics technique_ids | detections | | 250
rule_summary | top | timeline | rule_title level rule_id | detections distinct_principals distinct_ips distinct_actions first_seen last_seen | | 250
rules_over_time | series P1D | timeline | rule_title | detections | | 10000
run_info | top | provenance | source_file command command_line tool_version rules_version timestamp_tz | files_scanned events_scanned rules_loaded detections_written duplicates_removed | | 10
severity_breakdown | top | timeline | level | detections distinct_rules | | 10
top_event_names | top | timeline | event_name | detections distinct_rules | event_name IS NOT NULL | 25
top_principals | top | timeline | user_name | detections distinct_rules distinct_ips | user_name IS NOT NULL | 25
top_rules | top | timeline | rule_title | detections distinct_principals distinct_ips | | 25
top_source_ips | top | timeline | src_ip | detections distinct_principals distinct_rules first_seen last_seen active_span_minutes | src_ip IS NOT NULL | 250
top_user_agents | top | timeline | user_agent | detections distinct_principals first_seen last_seen | user_agent IS NOT NULL | 25
"""
FLOW_CHARTS = f"""
cov_configs | top | flow_log_configs | flow_log_id event_name traffic_type resource_ids account_id region user_identity_arn | recorded_at | | 100
cov_direction | pie | flow_records | direction_source | records | log_status = 'OK' | 20
cov_fields | top | flow_records | flow_log_id | recorded_direction_share packet_address_share tcp_flags_share bytes_share traffic_path_share encryption_status_share | log_status = 'OK' | 100
cov_sources | top | flow_sources | flow_log_id account_ids regions | files rows_total rows_with_issues rows_rejected nodata_rows skipdata_rows interfaces_seen header_variants first_observation last_observation | | 100
cov_status_ts | series PT1H | flow_records | log_status | records | log_status IN ('NODATA', 'SKIPDATA') | 10000
eg_by_path | top | flow_records | traffic_path_label | bytes_measured | {OUT} AND traffic_path_label IS NOT NULL | 20
eg_dns | top | flow_records | local_addr remote_addr protocol_name | records first_seen last_seen | {OUT} AND dstport = 53 | 100
eg_long_running | top | flow_records | local_addr remote_addr dstport protocol_name | observed_windows span_hours bytes_per_second bytes_measured | {OUT} AND {PUBLIC} AND log_status = 'OK' | 100
eg_outliers | top | flow_egress_daily | local_addr instance_id day | ratio_to_baseline egress_bytes baseline_bytes baseline_days remote_peers | ratio_to_baseline IS NOT NULL | 50
eg_smtp | top | flow_records | local_addr remote_addr dstport remote_geo_country_code | records bytes_measured first_seen | {OUT} AND {PUBLIC} AND dstport IN (25, 465, 587) | 100
eg_top_dest | top | flow_records | remote_addr | bytes_measured | {OUT} AND {PUBLIC} AND action = 'ACCEPT' | 20
eg_unusual_ports | top | flow_records | local_addr remote_addr dstport protocol_name remote_geo_country_code | records bytes_measured first_seen last_seen | {OUT} AND {PUBLIC} AND dstport IN (4444, 6667, 1337, 31337, 9001, 9030, 3333, 5555, 7777, 14444) | 100
geo_asn_out | top | flow_records | remote_geo_asn remote_geo_org | bytes_measured destinations | {OUT} AND {PUBLIC} AND action = 'ACCEPT' AND remote_geo_asn IS NOT NULL | 100
geo_country_action | top | flow_records | remote_geo_country_code remote_geo_country_name action | records | {IN} AND {PUBLIC} AND {PLACE} | 300
geo_country_port | top | flow_records | remote_geo_country_code dstport | records bytes_measured | {IN} AND {PUBLIC} AND action = 'ACCEPT' AND {PLACE} | 300
geo_kpi_asn | kpi | flow_records | | external_asns | direction_source = 'record' AND {PUBLIC}
geo_kpi_in | kpi | flow_records | | inbound_countries | {IN} AND {PUBLIC} AND {PLACE}
geo_kpi_out | kpi | flow_records | | outbound_countries | {OUT} AND {PUBLIC} AND {PLACE}
geo_map_in_acc | map | flow_records | remote_geo_country_code | records | {IN} AND {PUBLIC} AND action = 'ACCEPT' AND {PLACE} | 300
geo_map_in_rej | map | flow_records | remote_geo_country_code | records | {IN} AND {PUBLIC} AND action = 'REJECT' AND {PLACE} | 300
geo_map_out | map | flow_records | remote_geo_country_code | bytes_measured | {OUT} AND {PUBLIC} AND action = 'ACCEPT' AND {PLACE} | 300
geo_rare_out | top | flow_records | remote_geo_country_code remote_geo_country_name | records first_seen last_seen | {OUT} AND {PUBLIC} AND {PLACE} | 50 | asc
kpi_bytes | kpi | flow_records | | bytes_measured | log_status = 'OK'
kpi_enis | kpi | flow_records | | interfaces
kpi_peers | kpi | flow_records | | external_peers | direction_source = 'record' AND {PUBLIC} AND log_status = 'OK'
kpi_records | kpi | flow_records | | records | log_status = 'OK'
kpi_reject_ratio | kpi | flow_records | | reject_ratio | log_status = 'OK'
kpi_skipdata | kpi | flow_records | | skipdata_windows | log_status = 'SKIPDATA'
la_admin | top | flow_records | flow_src flow_dst dstport | observations bytes_measured first_seen last_seen observing_interfaces | {INSIDE} AND dstport IN (22, 135, 139, 445, 3389, 5985, 5986) | 200
la_fanout | top | flow_records | flow_src | distinct_internal_peers | {INSIDE} | 20
la_new_pairs | top | flow_internal_pairs | flow_src flow_dst dstport | first_seen observations bytes_measured | is_new_pair | 200
la_staging | top | flow_staging | host | internal_in_bytes external_out_bytes first_internal_in last_external_out external_peers | | 100
ov_bytes_ts | series PT1H | flow_records | flow_direction | bytes_measured | direction_source = 'record' AND log_status = 'OK' | 10000
ov_records_ts | series PT1H | flow_records | action | records | log_status = 'OK' | 10000
pe_table | top | flow_periodicity | local_addr remote_addr dstport protocol_name confidence | period_secs active_buckets jitter active_bucket_ratio bytes_cv skipdata_overlaps span_hours | | 200
po_aws_service | top | flow_records | pkt_dst_aws_service traffic_path_label | bytes_measured | {OUT} AND pkt_dst_aws_service IS NOT NULL AND traffic_path_label IS NOT NULL | 20
po_encryption | pie | flow_records | encryption | records | encryption_status IS NOT NULL | 20
po_middlebox | top | flow_records | interface_type resource_id interface_id | records bytes_measured | log_status = 'OK' AND via_middlebox | 100
po_offhours | heatmap | flow_records | hour_utc day_of_week | bytes_measured | {OUT} AND {PUBLIC} AND action = 'ACCEPT' | 10000
po_reject_reason | pie | flow_records | reject_reason | records | reject_reason IS NOT NULL | 20
pr_icmp | top | flow_records | flow_src flow_dst protocol_name | records bytes_measured first_seen | log_status = 'OK' AND protocol_name IN ('ICMP', 'ICMPv6') | 100
pr_ipv6 | top | flow_records | flow_src flow_dst dstport protocol_name | records bytes_measured first_seen | log_status = 'OK' AND ip_version = 6 | 100
pr_udp_fanout | top | flow_records | flow_src | distinct_external_peers | log_status = 'OK' AND protocol_name = 'UDP' AND dst_scope = 'public' | 20
pr_unusual | top | flow_records | protocol_name | records | log_status = 'OK' AND protocol NOT IN (1, 6, 17, 58) | 20
rc_admin | top | flow_records | remote_addr remote_geo_country_code local_addr dstport | records bytes_measured first_seen last_seen | {IN} AND {PUBLIC} AND action = 'ACCEPT' AND dstport IN (22, 3389, 5985, 5986, 3306, 5432, 1433, 6379, 9200, 27017, 2375, 10250) | 100
rc_horizontal | top | flow_records | remote_addr dstport remote_geo_country_code | distinct_targets records first_seen last_seen | {IN} AND {PUBLIC} | 50
rc_reject_accept | top | flow_reject_accept | remote_addr remote_geo_country_code local_addr dstport | rejects accepts first_reject last_accept | | 100
rc_syn_only | top | flow_records | remote_addr | syn_only_records | {IN} AND {PUBLIC} AND tcp_flags = 2 | 20
rc_top_rejected | top | flow_records | remote_addr | rejected_records | {IN} AND {PUBLIC} AND action = 'REJECT' | 20
rc_vertical | top | flow_records | remote_addr local_addr remote_geo_country_code | distinct_ports records first_seen last_seen | {IN} AND {PUBLIC} | 50
"""
AUDIT_CHARTS = f"""
access_denied_top_actions | top | | event_name | denied_count | error_code IN ('AccessDenied', 'Client.UnauthorizedAccess', 'UnauthorizedAccess', 'AccessDeniedException') | 50
agentcore_gateway_changes | top | | event_name user_identity_arn cedar_mode gateway_id | changes first_seen last_seen | @bedrock-agentcore: CreateGateway UpdateGateway DeleteGateway CreateGatewayTarget UpdateGatewayTarget DeleteGatewayTarget CreatePolicy UpdatePolicy DeletePolicy CreatePolicyEngine UpdatePolicyEngine PutResourcePolicy DeleteResourcePolicy | 200
agentcore_token_issuance | series P1D | | event_name | token_requests | @bedrock-agentcore: GetWorkloadAccessToken GetWorkloadAccessTokenForJWT GetWorkloadAccessTokenForUserId GetResourceOauth2Token GetResourceApiKey CreateWorkloadIdentity DeleteWorkloadIdentity SetTokenVaultCMK CreateApiKeyCredentialProvider CreateOauth2CredentialProvider | 10000
ami_snapshot_deletion | top | | {EVENT} | event_count | @ec2: DeregisterImage DeleteSnapshot | 100
assume_root_events | top | | {CALL} | event_count | @*: AssumeRoot | 100
assumed_role_external_ip | top | | event_time user_identity_arn source_ip_address geo_country_code geo_org event_name event_source aws_region error_code | event_count | user_identity_type = 'AssumedRole' AND source_ip_address IS NOT NULL AND source_ip_address <> 'AWS Internal' AND source_ip_address NOT LIKE '%.amazonaws.com' AND source_ip_address NOT LIKE '10.%' AND source_ip_address NOT LIKE '192.168.%' AND source_ip_address NOT LIKE '127.%' AND NOT matches(source_ip_address, '^172[.](1[6-9]/2[0-9]/3[01])[.]') | 200
auth_failure_success | top | | {CALLER} | failure_count success_count first_seen last_seen | {LOGIN} | 100
backup_vault_deletion | top | | {EVENT} | event_count | @backup: DeleteBackupVault DeleteBackupPlan DeleteRecoveryPoint DeleteBackupSelection DisassociateRecoveryPoint PutBackupVaultAccessPolicy DeleteBackupVaultLockConfiguration | 100
bedrock_callers_geo | top | | user_identity_arn source_ip_address geo_country_code geo_org user_agent | total_calls distinct_models first_seen last_seen | event_source = 'bedrock.amazonaws.com' | 200
bedrock_failed_invocations | top | | user_identity_arn error_code source_ip_address geo_country_code geo_city | failed_calls models_tried regions_tried | {INVOKE} & error_code IS NOT NULL | 100
bedrock_invocation_trend | series P1D | | user_identity_arn | invocation_count | {INVOKE} | 50000
bedrock_model_access_changes | top | | event_time event_name user_identity_arn aws_region source_ip_address geo_country_code geo_city user_agent error_code | event_count | @bedrock: PutUseCaseForModelAccess PutFoundationModelEntitlement CreateFoundationModelAgreement PutModelAccessConfig CreateProvisionedModelThroughput DeleteModelInvocationLoggingConfiguration PutModelInvocationLoggingConfiguration GetModelInvocationLoggingConfiguration | 200
cloudformation_changes | top | | {EVENT} | event_count | @cloudformation: CreateStack UpdateStack DeleteStack CreateChangeSet ExecuteChangeSet DeleteChangeSet CreateStackSet UpdateStackSet DeleteStackSet CreateStackInstances UpdateStackInstances DeleteStackInstances StopStackSetOperation | 200
cloudtrail_logging_gap | series PT1H fixed | | | event_count | | 10000
config_recorder_changes | top | | {EVENT} | event_count | @config: StopConfigurationRecorder DeleteConfigurationRecorder DeleteDeliveryChannel DeleteConfigRule PutConfigRule | 100
console_login_activity | top | | {CALLER} | total_logins failed_logins success_logins mfa_less_count | {LOGIN} | 50
container_platform_events | top | | {SERVICE} | event_count | @eks: CreateCluster DeleteCluster UpdateClusterConfig UpdateClusterVersion CreateNodegroup DeleteNodegroup CreateFargateProfile DeleteFargateProfile CreateAddon DeleteAddon AssociateEncryptionConfig AssociateIdentityProviderConfig; ecr: CreateRepository DeleteRepository PutImage BatchDeleteImage SetRepositoryPolicy DeleteRepositoryPolicy PutLifecyclePolicy DeleteLifecyclePolicy PutRegistryPolicy | 200
cross_account_assume_role | top | | user_identity_arn user_identity_account_id recipient_account_id source_ip_address geo_country_code geo_city | event_count | @*: AssumeRole AssumeRoleWithWebIdentity AssumeRoleWithSAML & {FOREIGN} | 100
cross_account_object_copy | top | | user_identity_arn destination_bucket copy_source recipient_account_id | copies first_seen last_seen | @s3: CopyObject PutObject & (event_name = 'CopyObject' OR request_parameters LIKE '%x-amz-copy-source%') | 200
data_access_scope | top | | user_identity_arn | read_calls distinct_buckets approx_distinct_objects first_access last_access | @s3: GetObject SelectObjectContent CopyObject ListObjects ListObjectsV2 | 100
dormant_reactivated | top | | user_identity_arn user_identity_type | first_seen last_seen total_events active_span_days | user_identity_arn IS NOT NULL | 50 | having active_span_days >= 3
ebs_direct_api | top | | {EVENT} | event_count | @ebs: ListSnapshotBlocks GetSnapshotBlock ListChangedBlocks PutSnapshotBlock StartSnapshot CompleteSnapshot | 100
ec2_instance_launches | top | | {CALL} | event_count | @ec2: RunInstances | 200
ec2_instance_profile | top | | {SERVICE} | event_count | @iam: CreateInstanceProfile DeleteInstanceProfile AddRoleToInstanceProfile RemoveRoleFromInstanceProfile; ec2: AssociateIamInstanceProfile DisassociateIamInstanceProfile ReplaceIamInstanceProfileAssociation | 200
ec2_key_pair | top | | {EVENT} | event_count | @ec2: CreateKeyPair ImportKeyPair DeleteKeyPair | 200
ec2_mass_stop | top | | {EVENT} | event_count | @ec2: StopInstances TerminateInstances | 200
ec2_public_snapshot | top | | {EVENT} | event_count | @*: ModifySnapshotAttribute ModifyImageAttribute & (lower(request_parameters) LIKE '%"group":"all"%' OR lower(request_parameters) LIKE '%group=all%') | 100
ec2_spot_fleet | top | | {EVENT} | event_count | @ec2: RequestSpotFleet ModifySpotFleetRequest CancelSpotFleetRequests CreateFleet DeleteFleet PurchaseReservedInstancesOffering RequestSpotInstances CancelSpotInstanceRequests PurchaseScheduledInstances | 200
ec2_user_data | top | | {CALL} | event_count | @ec2: ModifyInstanceAttribute & request_parameters LIKE '%userData%' | 200
ecs_task_definition | top | | {EVENT} | event_count | @ecs: RegisterTaskDefinition DeregisterTaskDefinition UpdateService CreateService DeleteService RunTask StartTask StopTask | 100
error_code_composition | series P1D fixed | | error_code | error_events | error_code IS NOT NULL AND error_code <> '' | 10000
error_trend | series PT1H | | error_code | error_count | error_code IS NOT NULL | 10000
event_timeseries | series PT1H fixed | | | read_events write_events | | 10000
eventbridge_cw_changes | top | | {SERVICE} | event_count | @events scheduler: PutRule DeleteRule DisableRule EnableRule PutTargets RemoveTargets PutPermission RemovePermission CreateSchedule DeleteSchedule UpdateSchedule; logs: PutSubscriptionFilter DeleteSubscriptionFilter PutDestination DeleteDestination DeleteLogGroup DeleteLogStream | 200
federated_login_origin | top | | federated_provider user_identity_arn geo_country_code geo_org | logins distinct_source_ips first_seen last_seen | @*: ConsoleLogin & json(additional_event_data, federatedProvider) IS NOT NULL | 200
first_time_services | top | | event_source | first_seen last_seen total_calls unique_callers regions_used | event_source IS NOT NULL | 100
fs_event_name | top | | event_name event_source | first_seen last_seen total_calls distinct_callers | | 50
fs_identity | top | | user_identity_arn user_identity_type | first_seen last_seen total_events distinct_apis distinct_ips active_span_days | user_identity_arn IS NOT NULL | 100
fs_source_ip | top | | source_ip_address geo_country_name geo_org | first_seen last_seen total_events distinct_identities distinct_apis | source_ip_address IS NOT NULL AND source_ip_address NOT LIKE '%.amazonaws.com' | 100
geo_asn_org_requests | top | | geo_org | request_count write_requests unique_identities | geo_org IS NOT NULL | 25
geo_city_requests | top | | geo_city geo_country_name | request_count write_requests unique_identities | geo_city IS NOT NULL | 25
geo_country_requests | top | | geo_country_name | event_count write_count unique_callers | geo_country_code IS NOT NULL | 50
geo_event_name_by_country | top | | event_name geo_country_name | event_count write_count unique_callers | geo_country_code IS NOT NULL AND geo_country_code NOT IN ('PRIVATE', 'LOOPBACK', 'LINK-LOCAL', 'SPECIAL') | 50
geo_world_map | map | | geo_country_code | event_count | geo_country_code IS NOT NULL | 10000
glue_sagemaker_iam_role | top | | {SERVICE} | event_count | @glue: CreateDevEndpoint UpdateDevEndpoint DeleteDevEndpoint GetDevEndpoint GetDevEndpoints GetConnections GetConnection CreateConnection DeleteConnection; sagemaker: CreateNotebookInstance UpdateNotebookInstance DeleteNotebookInstance StartNotebookInstance StopNotebookInstance CreatePresignedNotebookInstanceUrl CreateTrainingJob CreateProcessingJob | 100
hrm_security_service_mods | top | | {SERVICE} | event_count | @*: DeleteTrail StopLogging UpdateTrail PutEventSelectors DeletePolicy DetachPolicy | 500
hrm_timeseries | series P1D | | event_name | event_count | {RISKY} | 50000
hrm_top_actors | top | | user_identity_arn | event_count | {RISKY} | 50
hrm_top_calls | top | | event_name | event_count | {RISKY} | 43
iam_entity_activity | top | | user_identity_arn user_identity_type | total_events write_events error_events=failed_events write_ratio_pct last_seen | | 50
iam_entity_deletion | top | | {EVENT} | event_count | @iam: DeleteUser DeleteRole DeleteAccessKey DeleteLoginProfile DeletePolicy DeleteRolePolicy DeleteUserPolicy DeleteGroup DeleteGroupPolicy DeleteVirtualMFADevice DeactivateMFADevice DeleteInstanceProfile | 100
iam_principal_creation_timeline | series P1D fixed | | event_name | creation_events | @*: CreateUser CreateRole CreateAccessKey CreateLoginProfile CreateInstanceProfile | 10000
iam_privilege_change_timeline | series P1D | | event_name | event_count unique_callers | @*: PutUserPolicy AttachUserPolicy PutRolePolicy AttachRolePolicy CreatePolicyVersion SetDefaultPolicyVersion AddUserToGroup CreateRole UpdateAssumeRolePolicy | 10000
imds_options_changes | top | | {CALL} | event_count | @*: ModifyInstanceMetadataOptions | 100
impossible_travel | top | | user_identity_arn | distinct_countries distinct_source_ips event_count first_seen last_seen | geo_country_code IS NOT NULL | 100
kms_key_deletion | top | | {EVENT} | event_count | @kms: ScheduleKeyDeletion CancelKeyDeletion DisableKey EnableKey DeleteImportedKeyMaterial DisableKeyRotation DeleteCustomKeyStore DisconnectCustomKeyStore | 200
kpi_access_denied | kpi | | | access_denied_events=event_count | error_code ILIKE '%AccessDenied%' OR error_code ILIKE '%UnauthorizedOperation%' OR error_code ILIKE '%Forbidden%'
kpi_audit_tampering | kpi | | | defense_evasion_hits=event_count | @*: {TAMPERING} / {DETECTOR_OFF}
kpi_distinct_countries | kpi | | | distinct_countries
kpi_distinct_principals | kpi | | | distinct_principals
kpi_distinct_regions | kpi | | | active_regions
kpi_distinct_source_ips | kpi | | | distinct_source_ips
kpi_mfa_less_logins | kpi | | | mfa_less_logins=event_count | @signin: ConsoleLogin & json(additional_event_data, MFAUsed) = 'No'
kpi_non_mfa_api_calls | kpi | | | non_mfa_write_calls=event_count | session_mfa_authenticated = 'false' AND read_only IS NOT TRUE
kpi_p1_indicators | kpi | | | p1_triggers=event_count | @*: {ALARMS} / user_identity_type = 'Root' OR {DETECTOR_OFF}
kpi_p2_indicators | kpi | | | p2_triggers=event_count | @*: {ESCALATION} / event_name = 'AssumeRole' AND {FOREIGN}
kpi_root_events | kpi | | | root_events=event_count | user_identity_type = 'Root'
kpi_total_events | kpi | | | total_events
lambda_config_changes | top | | {EVENT} | event_count | @lambda: CreateFunction UpdateFunctionCode UpdateFunctionConfiguration DeleteFunction AddPermission RemovePermission CreateEventSourceMapping DeleteEventSourceMapping CreateFunctionUrlConfig UpdateFunctionUrlConfig DeleteFunctionUrlConfig PublishLayerVersion AddLayerVersionPermission RemoveLayerVersionPermission | 200
login_heatmap | heatmap | | hour_utc day_of_week | login_count | {LOGIN} | 10000
mfa_less_login_trend | series P1D fixed | | | mfa_less_logins mfa_logins | @signin: ConsoleLogin | 1000
monitoring_posture_recon | top | | {SERVICE} | posture_probe_count | @*: DescribeTrails GetTrailStatus GetEventSelectors GetInsightSelectors ListTrails ListDetectors GetDetector GetFindingsStatistics ListFindings ListIPSets ListThreatIntelSets DescribeConfigurationRecorders DescribeConfigurationRecorderStatus DescribeDeliveryChannels DescribeConfigRules ListAnalyzers DescribeHub GetEnabledStandards DescribeFlowLogs DescribeAlarms DescribeLogGroups | 200
nacl_route_changes | top | | {EVENT} | event_count | @ec2: CreateNetworkAcl DeleteNetworkAcl CreateNetworkAclEntry DeleteNetworkAclEntry ReplaceNetworkAclEntry ReplaceNetworkAclAssociation CreateRoute DeleteRoute ReplaceRoute CreateRouteTable DeleteRouteTable AssociateRouteTable DisassociateRouteTable ReplaceRouteTableAssociation | 200
off_hours_heatmap | heatmap | | hour_utc day_of_week | write_events=events_per_hour | read_only IS NOT TRUE | 10000
org_membership_changes | top | | {EVENT} | event_count | @organizations: LeaveOrganization RemoveAccountFromOrganization AcceptHandshake CancelHandshake DeclineHandshake InviteAccountToOrganization | 100
org_scp_changes | top | | event_time event_name user_identity_arn user_identity_account_id source_ip_address geo_country_code geo_city error_code | event_count | @organizations: CreatePolicy UpdatePolicy DeletePolicy AttachPolicy DetachPolicy DisablePolicyType EnablePolicyType CreateOrganizationalUnit DeleteOrganizationalUnit MoveAccount RemoveAccountFromOrganization LeaveOrganization DeleteOrganization RegisterDelegatedAdministrator DeregisterDelegatedAdministrator | 100
permission_set_grants | series P1D | | event_name | grants | @sso: CreatePermissionSet UpdatePermissionSet DeletePermissionSet AttachManagedPolicyToPermissionSet PutInlinePolicyToPermissionSet AttachCustomerManagedPolicyReferenceToPermissionSet CreateAccountAssignment DeleteAccountAssignment ProvisionPermissionSet | 10000
principal_daily_volume | series P1D | | user_identity_arn | read_calls=read_only_calls write_calls | user_identity_arn IS NOT NULL | 10000
ransom_note_placement | top | | user_identity_arn bucket_name object_key source_ip_address geo_country_code geo_city geo_org | notes first_seen last_seen | @s3: PutObject & matches(upper(coalesce(json(request_parameters, key), '')), 'RANSOM/DECRYPT/RECOVER/RESTORE[_-]?FILES/README/HOW[_-]?TO/YOUR[_-]?FILES/UNLOCK') | 100
rds_deleted_no_snapshot | top | | {EVENT} | event_count | @*: DeleteDBInstance DeleteDBCluster & json(request_parameters, skipFinalSnapshot) = 'true' | 100
rds_manipulation | top | | {EVENT} | event_count | @rds-data: ExecuteStatement BatchExecuteStatement; rds: RestoreDBInstanceFromDBSnapshot RestoreDBClusterFromSnapshot DownloadDBLogFilePortion | 100
rds_snapshot_share | top | | {EVENT} | event_count | @*: ModifyDBSnapshotAttribute ModifyDBClusterSnapshotAttribute & (request_parameters LIKE '%restore%' OR request_parameters LIKE '%valuesToAdd%') | 100
region_activity | top | | aws_region | event_count write_count write_ratio_pct unique_callers | aws_region IS NOT NULL | 30
role_chain_depth | top | | session_issuer_arn to_role | hops distinct_source_ips first_seen last_seen | @*: AssumeRole & user_identity_type = 'AssumedRole' AND session_issuer_arn IS NOT NULL | 200
root_account_usage | top | | event_name event_source source_ip_address geo_country_code geo_city | call_count error_count=failed_events | user_identity_type = 'Root' | 100
route53_dns_changes | top | | {EVENT} | event_count | @route53: CreateHostedZone DeleteHostedZone ChangeResourceRecordSets CreateResolverRule DeleteResolverRule AssociateResolverRule DisassociateResolverRule UpdateResolverRule | 100
runinstances_by_region | series P1D fixed | | aws_region | run_instances | @*: RunInstances | 10000
s3_bucket_policy_changes | top | | {EVENT} | event_count | @s3: PutBucketPolicy DeleteBucketPolicy PutBucketAcl PutBucketCors PutBucketWebsite DeleteBucketWebsite | 100
s3_bulk_deletion | top | | hour_bucket {CALLER} | delete_count | @s3: DeleteObject DeleteObjects | 200 | having delete_count >= 50
s3_bulk_download | top | | hour_bucket {CALLER} | get_object_count | @s3: GetObject | 200 | having get_object_count >= 100
s3_cross_account_replication | top | | {EVENT} | event_count | @s3: PutBucketReplication DeleteBucketReplication | 100
s3_lifecycle_deletion | top | | {EVENT} | event_count | @s3: PutBucketLifecycle PutBucketLifecycleConfiguration DeleteBucketLifecycle | 100
s3_list_activity | top | | {CALLER} aws_region error_code | call_count distinct_operations | @s3: ListBuckets ListObjects ListObjectsV2 ListObjectVersions ListMultipartUploads HeadBucket HeadObject | 200
s3_protection_changes | top | | {EVENT} | event_count | @s3: PutBucketLogging DeleteBucketPolicy PutBucketPolicy PutPublicAccessBlock DeletePublicAccessBlock PutBucketAcl PutBucketVersioning PutBucketEncryption DeleteBucketEncryption PutBucketReplication DeleteBucketReplication | 200
s3_ssec_encryption | top | | {EVENT} | event_count | @s3: CopyObject PutObject PutBucketEncryption & (event_name = 'PutBucketEncryption' OR json(additional_event_data, SSEApplied) = 'SSE_C') | 100
s3_versioning_logging_disabled | top | | {EVENT} | event_count | @s3: PutBucketVersioning PutBucketLogging & (request_parameters LIKE '%Suspended%' OR request_parameters LIKE '%"BucketLoggingStatus":{{}}%' OR request_parameters LIKE '%"LoggingEnabled":{{}}%') | 100
security_group_changes | top | | {EVENT} | event_count | @ec2: AuthorizeSecurityGroupIngress AuthorizeSecurityGroupEgress RevokeSecurityGroupIngress RevokeSecurityGroupEgress CreateSecurityGroup DeleteSecurityGroup UpdateSecurityGroupRuleDescriptionsIngress UpdateSecurityGroupRuleDescriptionsEgress ModifySecurityGroupRules | 200
security_monitoring_changes | top | | {SERVICE} | event_count | @*: StopLogging DeleteTrail UpdateTrail PutEventSelectors PutInsightSelectors UpdateDetector DeleteDetector DeletePublishingDestination CreateFilter UpdateFilter DeleteConfigRule StopConfigurationRecorder DeleteDeliveryChannel DeleteFlowLogs DeleteLogGroup DeleteLogStream PutRetentionPolicy DisableSecurityHub DeleteAnalyzer | 200
security_relevant_api_calls | top | | event_name event_source | call_count unique_callers error_count=failed_events | @*: CreateUser CreateAccessKey DeleteAccessKey UpdateAccessKey CreateLoginProfile UpdateLoginProfile AttachUserPolicy AttachRolePolicy AttachGroupPolicy PutUserPolicy PutRolePolicy PutGroupPolicy CreateRole UpdateAssumeRolePolicy CreatePolicy CreatePolicyVersion SetDefaultPolicyVersion AssumeRole AssumeRoleWithSAML AssumeRoleWithWebIdentity GetFederationToken GetSessionToken PutBucketPolicy PutBucketAcl PutObjectAcl DeleteBucketPolicy DeleteBucketEncryption PutPublicAccessBlock AuthorizeSecurityGroupIngress AuthorizeSecurityGroupEgress CreateSecurityGroup RevokeSecurityGroupIngress StopLogging DeleteTrail UpdateTrail DisableKey ScheduleKeyDeletion CancelKeyDeletion CreateGrant ConsoleLogin CreateOAuth2Token AuthorizeOAuth2Access RunInstances CreateFunction CreateBucket DeleteBucket DeactivateMFADevice DeleteVirtualMFADevice UpdateDetector DeleteDetector DeleteConfigRule StopConfigurationRecorder DisableSecurityHub DeleteAnalyzer GetSecretValue GetParameter GetParametersByPath RegisterDelegatedAdministrator LeaveOrganization DeleteFlowLogs DeleteLogGroup | 100
ses_sns_sending_quota | top | | event_source event_time event_name user_identity_arn changed_value source_ip_address aws_region geo_country_code geo_city error_code | send_enablement_events | @*: SetSMSAttributes OptInPhoneNumber CheckIfPhoneNumberIsOptedOut UpdateAccountSendingEnabled PutAccountSendingAttributes PutAccountDetails UpdateConfigurationSetSendingEnabled SendRawEmail SendTemplatedEmail SendBulkTemplatedEmail SendBulkEmail | 200
session_key_activity | top | | user_identity_access_key_id user_identity_arn | api_calls distinct_apis distinct_source_ips distinct_regions first_seen last_seen | user_identity_access_key_id LIKE 'ASIA%' | 200
single_api_region_fanout | top | | hour_bucket user_identity_arn event_name event_source | distinct_regions call_count distinct_source_ips | user_identity_arn IS NOT NULL AND aws_region IS NOT NULL AND event_source NOT IN ('iam.amazonaws.com', 'sts.amazonaws.com', 'signin.amazonaws.com', 'organizations.amazonaws.com', 'cloudfront.amazonaws.com', 'route53.amazonaws.com') | 100 | having distinct_regions >= 3
source_ip_requests | top | | source_ip_address geo_country_code geo_city geo_org | request_count unique_identities write_requests | | 100
ssm_execution | top | | {EVENT} | event_count | @ssm: StartSession TerminateSession ResumeSession SendCommand StartAutomationExecution | 200
sso_events | top | | {SERVICE} | event_count | event_source IN ('sso.amazonaws.com', 'sso-directory.amazonaws.com', 'identitystore.amazonaws.com', 'sso-oauth.amazonaws.com') | 200
storage_reencryption | top | | {EVENT} | event_count | @*: CopySnapshot CopyImage CreateVolume CopyDBSnapshot CopyDBClusterSnapshot & json(request_parameters, kmsKeyId) IS NOT NULL / event_name = 'DisableEbsEncryptionByDefault' | 100
throttling_spikes | series PT1H | | event_source | throttle_count affected_principals | error_code IN ('ThrottlingException', 'Throttling', 'RequestLimitExceeded', 'TooManyRequestsException', 'ServiceUnavailableException') | 10000
top_api_calls | top | | event_name | call_count | | 50
user_agent_analysis | top | | user_agent | request_count write_requests error_requests unique_identities | | 50
velocity_spikes | top | | hour_bucket user_identity_arn | events_per_hour | user_identity_arn IS NOT NULL | 200 | having events_per_hour >= 50
vpc_flowlog_changes | top | | {EVENT} | event_count | @ec2: DeleteFlowLogs CreateFlowLogs | 100
vpc_infrastructure_changes | top | | {EVENT} | event_count | @ec2: CreateVpc DeleteVpc ModifyVpcAttribute CreateSubnet DeleteSubnet ModifySubnetAttribute CreateInternetGateway AttachInternetGateway DetachInternetGateway DeleteInternetGateway CreateNatGateway DeleteNatGateway CreateVpcEndpoint ModifyVpcEndpoint DeleteVpcEndpoints AllocateAddress AssociateAddress DisassociateAddress ReleaseAddress | 200
vpc_peering_tgw | top | | {EVENT} | event_count | @ec2: CreateVpcPeeringConnection AcceptVpcPeeringConnection RejectVpcPeeringConnection DeleteVpcPeeringConnection ModifyVpcPeeringConnectionOptions CreateTransitGateway DeleteTransitGateway ModifyTransitGateway CreateTransitGatewayVpcAttachment DeleteTransitGatewayVpcAttachment ModifyTransitGatewayVpcAttachment AcceptTransitGatewayVpcAttachment RejectTransitGatewayVpcAttachment CreateTransitGatewayPeeringAttachment AcceptTransitGatewayPeeringAttachment DeleteTransitGatewayPeeringAttachment | 200
waf_changes | top | | {SERVICE} | event_count | @wafv2 waf: CreateWebACL UpdateWebACL DeleteWebACL CreateIPSet UpdateIPSet DeleteIPSet CreateRuleGroup UpdateRuleGroup DeleteRuleGroup PutLoggingConfiguration DeleteLoggingConfiguration AssociateWebACL DisassociateWebACL CreateRegexPatternSet UpdateRegexPatternSet DeleteRegexPatternSet | 200
workspaces_activity | top | | {EVENT} | event_count | @workspaces: CreateWorkspaces CreateWorkspacesPool CreateStandbyWorkspaces ModifyWorkspaceProperties RebuildWorkspaces | 100
write_read_ratio | series PT1H fixed | | | read_events write_events | | 10000
"""
#: Catalogues by prefix of their numbers, with the dataset of lines that name none.
CATALOGUES = {"CC": (AUDIT_CHARTS, "audit_events"), "CV": (FLOW_CHARTS, ""), "CT": (TIMELINE_CHARTS, ""), "CS": (SUMMARY_CHARTS, ""), "CM": (METRICS_CHARTS, "")}
#: Columns of event times by dataset.
CLOCKS = {"flow_records": "start_time"}


@dataclass(frozen=True)
class Spec:
    """A chart; measures are (name, SQL) pairs, dimensions too. `fixed`: a series without an order, which has no rare variant."""

    number: str
    name: str
    shape: str
    dataset: str
    dims: tuple[tuple[str, str], ...]
    measures: tuple[tuple[str, str], ...]
    where: str = ""
    having: str = ""
    limit: int | None = None
    order: tuple[str, str] = ("", "")
    ascending: bool = False
    fixed: bool = False

    @property
    def rankable(self) -> bool:
        """Whether turning the order gives another chart."""
        return self.shape in {"top", "series"} and not self.fixed

    def rare(self) -> Spec:
        """The chart with the least first, by its first measure."""
        return replace(self, name=f"{self.name}_rare", ascending=True, order=self.measures[0])


def condition(text: str) -> str:
    """SQL of a condition; after an @: services with actions, joined by ;, then `& more` or `/ instead`."""
    if not text.startswith("@"):
        return text
    text, instead = (*text[1:].split(" / ", 1), "")[:2]
    text, more = (*text.split(" & ", 1), "")[:2]
    parts = []
    for part in text.split("; "):
        services, actions = part.split(": ")
        names = ", ".join(f"'{a}'" for a in actions.split())
        sources = ", ".join(f"'{s}.amazonaws.com'" for s in services.split())
        parts.append(f"event_name IN ({names})" if services == "*" else f"event_source IN ({sources}) AND event_name IN ({names})")
    out = " OR ".join(f"({p})" for p in parts)
    out = f"({out}) AND {more}" if more else out
    return f"({out}) OR {instead}" if instead else out


def spec(number: str, line: str, dataset: str) -> Spec:
    """A chart out of its line."""
    name, shape, own, dims, measures, where, limit, order, *_ = [*(f.strip() for f in line.split("|")), "", "", "", ""]
    dataset = own or dataset
    clock = CLOCKS.get(dataset, "event_time")
    shape, *grain = shape.split()
    by = [(d, DIMENSIONS.get(d, d).replace("(time)", f"({clock})")) for d in dims.split()]
    if shape == "series":
        unit = {"PT5M": f"five({clock})", "PT1H": f"date_trunc('hour', {clock})", "P1D": f"date_trunc('day', {clock})"}[grain[0]]
        by = [("bucket", unit), *by]
    known = MEASURES | OWN.get(dataset, {})
    values = tuple((m.split("=")[0], known[m.split("=")[-1]]) for m in measures.split())
    having = order.removeprefix("having ") if order.startswith("having ") else ""
    chosen = (order, known[order]) if order in known else values[0]
    return Spec(number, name, shape, dataset, tuple(by), values, condition(where), having, int(limit) if limit else None, chosen, order == "asc", "fixed" in grain)


def catalogue(prefix: str) -> list[Spec]:
    """The charts of a catalogue, numbered by name."""
    text, dataset = CATALOGUES[prefix]
    return [spec(f"{prefix}{i:03}", line, dataset) for i, line in enumerate(sorted(text.strip().split("\n")), 1)]
