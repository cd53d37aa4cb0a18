"""Reading and writing of alerts, series and results."""
