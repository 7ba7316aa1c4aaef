"""Readers and writers: telemetry, logs, report files, exports."""
