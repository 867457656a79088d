"""The registered queries: each operator over whole tables, with its SQL twin."""
