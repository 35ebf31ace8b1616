"""Where ``sales`` comes from and where it goes."""
