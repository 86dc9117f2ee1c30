"""From formula text to syntax trees and Spark columns."""
