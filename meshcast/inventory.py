
BY_ID = {
    "SRC-1": "flt_filter", "SRC-2": "tests", "SRC-3": "tests", "SRC-4": "tests", "SRC-5": "tests", "SRC-6": "tests", "SRC-7": "src_matrix", "SRC-8": "src08_matrix_steps", "SRC-9": "tests",
    "SNK-1": "tests", "SNK-2": "tests", "SNK-3": "tests", "SNK-4": "tests",
    "PRJ-1": "dq03_consolidated", "PRJ-2": "dq11_daylight_dataset", "PRJ-3": "prj_timestamp", "PRJ-4": "prj_timestamp", "PRJ-5": "dq03_consolidated", "PRJ-6": "dq03_consolidated", "PRJ-7": "prj_clearness",
    "PRJ-8": "prj_decode prj08_labels", "PRJ-9": "prj_surface_pressure", "PRJ-10": "agg_resample_day", "PRJ-11": "agg_day_classes", "PRJ-12": "prj_month_name", "PRJ-13": "prj_snap", "PRJ-14": "prj_hours_in_year",
    "PRJ-15": "agg_wind_rose", "PRJ-16": "agg_wind_rose", "PRJ-17": "prj_mercator", "PRJ-18": "prj_mercator", "PRJ-19": "prj19_variables", "PRJ-20": "prj20_bytes", "PRJ-21": "prj21_mean_and_max",
    "FLT-1": "flt_filter", "FLT-2": "flt_filter", "FLT-3": "flt_filter", "FLT-4": "flt_days", "FLT-5": "flt_between", "FLT-6": "flt_filter", "FLT-7": "flt_filter", "FLT-8": "flt_filter", "FLT-9": "flt_filter",
    "FLT-10": "flt_daylight_mask", "FLT-11": "flt11_month flt11_day", "FLT-12": "flt12_checked", "FLT-13": "flt_near_focus", "FLT-14": "flt_polygon flt14_border", "FLT-15": "flt_water_nodes", "FLT-16": "flt16_complete", "FLT-17": "flt17_hour", "FLT-18": "tests",
    "JN-1": "agg_node_summary", "JN-2": "agg_resource_map", "JN-3": "plan_fusion", "JN-4": "agg_years_by_month", "JN-5": "dq_anomaly_counts", "JN-6": "jn06_renumbered", "JN-7": "jn07_kept_ids", "JN-8": "jn08_dropped_ids",
    "JN-9": "grid_pending", "JN-10": "jn10_time_axis dq19_calibrated_grid", "JN-11": "flt_near_focus", "JN-12": "agg_node_summary", "JN-13": "grid_match_report",
    "AGG-1": "agg_describe", "AGG-2": "agg_node_summary", "AGG-3": "agg_flags", "AGG-4": "agg_day_classes agg_day_classes_by_node", "AGG-5": "agg_day_counts", "AGG-6": "agg_years_by_month agg06_clearness_by_year",
    "AGG-7": "agg_years_by_node agg07_years_by_node_with_places", "AGG-8": "agg_years_total", "AGG-9": "dq_completeness agg09_node_completeness", "AGG-10": "dq_duplicate_count", "AGG-11": "dq_incomplete_nodes", "AGG-12": "dq_null_counts",
    "AGG-13": "dq_anomaly_counts", "AGG-14": "dq_filled", "AGG-15": "dq_anomaly_counts", "AGG-16": "agg_histogram agg16_centre", "AGG-17": "agg_time_series", "AGG-18": "agg_daily_profile", "AGG-19": "agg_correlations",
    "AGG-20": "agg_spearman agg20_spearman_matrix", "AGG-21": "agg_resample_day agg_resample_month_by_node agg21_resample_hour", "AGG-22": "agg_outliers_zscore", "AGG-23": "agg_outliers_iqr agg23_outliers_default", "AGG-24": "agg_wind_rose",
    "AGG-25": "agg_wind_rose_by_month", "AGG-26": "agg_boxplot agg26_boxplot_by_hour", "AGG-27": "agg_month_hour", "AGG-28": "agg_resource_map", "AGG-29": "agg29_delta_map agg29_delta_map_relative", "AGG-30": "agg_node_summary",
    "AGG-31": "agg_resource_map", "AGG-32": "agg_twelve_months agg32_panel", "AGG-33": "agg33_map_summary", "AGG-34": "agg_daily_spatial agg34_monthly_mean agg34_yearly_mean", "AGG-35": "agg_hourly_rules", "AGG-36": "agg_hourly_rules",
    "AGG-37": "agg_hourly_rules", "AGG-38": "agg_hourly_rules", "AGG-39": "agg39_hourly_means", "AGG-40": "agg_summary", "AGG-41": "agg41_node_list agg41_row_counts", "AGG-42": "agg_extent agg42_extent_of_focus",
    "AGG-43": "agg_retention", "AGG-44": "grid_multiplicity", "AGG-45": "grid_elevation_summary", "AGG-46": "grid_match_report", "AGG-47": "grid_match_report",
    "WIN-1": "win_node_order win01_by_place", "WIN-2": "grid_first_per_cell", "WIN-3": "win03_cell_numbers", "WIN-4": "grid_duplicate_flags", "WIN-5": "dq_duplicate_rows", "WIN-6": "win_duration_curve win06_duration_rows",
    "WIN-7": "grid_steps", "WIN-8": "grid_id_map",
    "SRT-1": "dq11_daylight_dataset", "SRT-2": "srt02_days", "SRT-3": "srt_limited_anomalies", "SRT-4": "srt04_first_pending", "SRT-5": "srt05_preview", "SRT-6": "srt06_flags_in_order",
    "SET-1": "tests", "SET-2": "set02_without_metadata", "SET-3": "tests", "SET-4": "set_selection", "SET-5": "grid_upsert set05_upsert", "SET-6": "set06_wide",
    "DQ-1": "dq01_integrity", "DQ-2": "dq_anomalies", "DQ-3": "dq03_consolidated", "DQ-4": "dq04_complement_gate", "DQ-5": "dq05_master_gate dq05_master", "DQ-6": "dq06_feature_year", "DQ-7": "plan_fusion dq07_fusion_audit",
    "DQ-8": "dq08_fused_24h", "DQ-9": "grid_ingest_state dq09_states", "DQ-10": "dq10_without_metadata", "DQ-11": "dq11_daylight_dataset dq11_daylight_report", "DQ-12": "grid_id_map", "DQ-13": "dq13_differing_cells dq13_twins",
    "DQ-14": "dq14_regridded dq14_gate dq14_regridded_series", "DQ-15": "dq15_lineage dq15_facts dq15_missing_sources", "DQ-16": "dq16_nodes dq16_facts", "DQ-17": "dq17_candidates dq17_statistics", "DQ-18": "dq18_reconstructed", "DQ-19": "dq19_calibrated_grid",
    "DQ-20": "dq20_pending dq20_confirmed", "DQ-21": "plan_hour_audit", "DQ-22": "dq22_node_audit", "DQ-23": "dq23_report_profile dq23_report_resource", "DQ-24": "dq24_topology",
}
