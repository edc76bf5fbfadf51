"""Plan-level helpers: SQL functions, broadcast guards, plan inspection."""
