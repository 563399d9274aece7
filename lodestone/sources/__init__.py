"""Sources and sinks of source files, logs, probes and projects."""
