"""Reading: file systems, the log, snapshots, deletion vectors and scans."""
