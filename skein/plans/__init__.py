"""The operators bound to tables, with equivalent SQL."""
