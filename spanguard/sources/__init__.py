"""Sources and sinks: chat requests, server-sent events, the conversation store, configuration."""
