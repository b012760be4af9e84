"""Multi-step runs: batch job, warehouse, views, reports."""
