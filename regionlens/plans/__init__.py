"""Plans that derive the analytic inputs from the raw tables, and the registered query set."""
