"""Reading and writing of tables, landed pages and uploaded files."""
