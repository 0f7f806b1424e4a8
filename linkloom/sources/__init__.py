"""Sources and sinks: post-stream messages, the label log and the settings table."""
