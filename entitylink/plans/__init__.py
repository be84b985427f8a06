"""End-to-end plans, the command line and the registered queries."""
