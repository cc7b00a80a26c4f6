"""Oracle SQL per registered query name."""

from __future__ import annotations

from clickforge.plans import oracle as O
from clickforge.plans import oracle_features as OF
from clickforge.plans import oracle_more as OM
from clickforge.plans import oracle_requests as OR

ORACLE: dict[str, str] = {
    "metrics_by_model": O.metric_row_sql(["model"]),
    "metrics_by_segment": O.metric_row_sql(["model", "segment"]),
    "label_detection": OF.label_detection_sql("labels", OF.LABELS_COLUMNS),
    "label_detection_impressions": OF.label_detection_sql("impressions", OF.IMPRESSION_COLUMNS,
                                                          ("impressions",)),
    "feature_types": OF.feature_types_sql(),
    "category_normalize": OF.category_normalize_sql(),
    "frequency_codes": OF.frequency_codes_sql(),
    "target_encoding": OF.target_encoding_sql(),
    "cross_codes": OF.cross_codes_sql(),
    "feature_matrix": OF.feature_matrix_sql(),
    "leaderboard": OM.leaderboard_sql(),
    "best_model": OM.best_model_sql(),
    "ap_rowwise": OM.ap_rowwise_sql(),
    "loss_metrics": OM.loss_metrics_sql(),
    "prediction_summary": OM.prediction_summary_sql(),
    "class_weights": OM.class_weights_sql(),
    "click_rate_by_value": OM.click_rate_by_value_sql(),
    "stratified_folds": OM.folds_sql(),
    "stratified_holdout": OM.holdout_sql(),
    "generated_ids": OM.ids_sql(),
    "ctr_correction": OM.ctr_correction_sql(),
    "prediction_quantiles": OM.quantiles_sql(),
    "post_process": OM.post_process_sql(),
    "submission": OM.submission_sql(),
    "ensemble_weights": OM.ensemble_weights_sql(),
    "ensemble_strategies": OM.ensemble_strategies_sql(),
    "comparison_report": OM.comparison_report_sql(),
    "request_features": OR.request_features_sql(),
    "request_responses": OR.request_responses_sql(),
    "response_records": OR.response_records_sql(),
    "serving_stats": OR.serving_stats_sql(),
    "api_usage": OR.api_usage_sql(),
    "api_usage_pipeline": OR.api_usage_pipeline_sql(),
    "open_context_features": OR.open_context_features_sql(),
    "context_keys": OR.context_keys_sql(),
    "stream_serving_stats": OR.serving_stats_sql(),
    "recent_predictions": OR.recent_predictions_sql(),
    "stream_scoring": OR.request_responses_sql(),
    "stream_window_stats": OR.stream_window_stats_sql(),
    "processed_requests": OR.processed_requests_sql(),
    "stream_processed_requests": OR.processed_requests_sql(),
    "experiment_log": OM.experiment_log_sql(),
    "experiment_summary": OM.experiment_summary_sql(),
    "sample_rows": OM.sample_rows_sql(),
    "dataset_check": OM.dataset_check_sql(),
    "alignment_check": OM.alignment_check_sql(),
    "distinct_counts": OM.distinct_counts_sql(),
    "minimal_features": OM.minimal_features_sql(),
    "basic_features": OM.basic_features_sql(),
    "table_scoring": OM.table_scoring_sql(),
    "submission_csv": OM.submission_csv_sql(),
    "evaluation_report": OM.comparison_report_sql(),
    "leaderboard_repaired": OM.leaderboard_repaired_sql(),
    "metrics_unrepaired": OM.metrics_unrepaired_sql(),
    "missing_column_features": OM.missing_column_sql(),
    "cleaned_values": OM.cleaned_values_sql(),
    "ensemble_main": OM.ensemble_main_sql(),
    "keyed_metrics": OM.keyed_metrics_sql(),
    "submission_template": OM.submission_template_sql(),
    "label_confirmation": OM.label_confirmation_sql(),
    "fold_metrics_summary": OM.fold_metrics_summary_sql(),
    "training_report": OM.training_report_sql(),
    "batches_by_name": OM.batches_by_name_sql(),
    "default_predictions": OM.default_predictions_sql(),
    "diversity_noise": OM.diversity_noise_sql(),
    "experiment_export": OM.experiment_export_sql(),
    "scoring_features": f"select * from ({OF.feature_matrix_sql()}) where split = 'test'",
}
