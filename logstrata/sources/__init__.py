"""Where logs are kept: runs with a manifest, value logs, write-ahead logs."""
