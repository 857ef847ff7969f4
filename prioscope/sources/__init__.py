"""Where tickets come from and where results go."""
