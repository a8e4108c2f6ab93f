"""The engine's entry points and the registered queries."""
