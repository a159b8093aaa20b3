"""Score tables, reports and jobs: functions from tables to DataFrames."""
