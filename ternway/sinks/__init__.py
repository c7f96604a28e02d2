"""Result files and reports."""
