"""Schemas of the rows that pass between operators, as DDL."""

from __future__ import annotations

#: A raw alert as it arrives.
RAW_ALERT = ("time string, signature string, ip string, host string, short string, label string, event_label string")
#: A parsed, tokenised alert.
ALERT = ("row_id bigint, alert_id string, time bigint, time_norm timestamp, signature string, ip string, host string, short string, label string, tokens array<string>")
#: Which group an alert went to.
GROUPING = ("row_id bigint, alert_id string, group_id string, method string, is_outlier boolean, reason string")
#: A group of alerts: the fact row of mining and evaluation.
ALERT_GROUP = (
    "alert_group_id string, group_id string, method string, start_ts bigint, end_ts bigint, n_alerts bigint, group_label string, weight double, "
    "raw_items array<string>, is_outlier boolean, alert_ids array<string>, sorted_items array<array<string>>, alert_ips array<string>, "
    "alert_labels array<string>, context_steps array<array<string>>, proto int, ext_ip string, int_ip string, int_port int, ext_port int, "
    "int_ip_is_multiple boolean, ext_ip_is_multiple boolean, ext_port_is_multiple boolean, int_port_is_multiple boolean, category string, "
    "ruleset string, cve_refs array<string>, qualifiers array<string>, signature_matches_per_day double, similarity double, "
    "signature_id_similarity double, attr_similarities map<string,double>, scas int"
)
