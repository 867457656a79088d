"""Writers: tables, nested JSON, text, CSV, registry and run log."""
