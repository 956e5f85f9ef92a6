"""Readers and sinks: log files of many layouts, captures, stored reports."""
