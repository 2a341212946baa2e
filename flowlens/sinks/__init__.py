"""Result files and dead letters."""
