"""All queries over the reference's own operators, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from palimpsest.jobs import inference_jobs, judge_jobs, language_jobs, metric_jobs, mixed_jobs, model_jobs, report_jobs, resampling_jobs, stats_jobs, text_jobs

FLAGSHIP = "rewrite_similarity"
_JOBS = text_jobs.JOBS | stats_jobs.JOBS | metric_jobs.JOBS | inference_jobs.JOBS | model_jobs.JOBS | mixed_jobs.JOBS | resampling_jobs.JOBS | report_jobs.JOBS | language_jobs.JOBS | judge_jobs.JOBS
QUERIES = {name: job for name, (job, _) in _JOBS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _JOBS.items() if sql is not None}
