"""Where packets and results come from."""
