"""Find leaked credentials in tables of files and in their commit history, on Spark."""

from keysweep.operators.report import write_report, write_report_file
from keysweep.plans.incremental import IncrementalScan
from keysweep.plans.scan import HistoryScan, scan_directory, scan_files, scan_readable
from keysweep.sources.rules import load_rules

__all__ = ["HistoryScan", "IncrementalScan", "load_rules", "scan_directory", "scan_files", "scan_readable", "write_report", "write_report_file"]
