"""Registered queries: what the engine runs over whole tables, with equivalent SQL."""
