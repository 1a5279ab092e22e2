"""Own résumé text in the usual form."""

RESUME = """Mara Lindqvist

7 Harbour Lane, Bristol, Avon BS1 4XE, United Kingdom | (555) 987-6543 | mara.lindqvist@post.example.org | linkedin.com/in/maralindqvist | https://mara.example.org/cv

---
Professional Summary
---

Senior data engineer with long practice in building batch and streaming systems for finance teams.
Builds reliable pipelines with Python and SQL, cares for tests and for clear documentation.

---
Work Experience
---

Senior Data Engineer
Northwind Analytics, Bristol, Avon
(March 2019 – Present)
Leads the platform team.
- Cut the nightly load by 35% with Python and Kafka.
- Moved reports to PostgreSQL (on AWS).

Data Engineer
Blue River Ltd, Leeds, Yorkshire
(2016 – 2020)
- Built SQL models for trading and audit.

---
Education
---

Master of Science in Statistics
University of Leeds, Leeds, Yorkshire
(2010 – 2012)
- GPA: 3.8
- Graduated with distinction

---
Skills
---

- Programming Languages: Python, SQL, Go
- Cloud: AWS (S3, Lambda), Kubernetes
- Databases: PostgreSQL, Redis
- Soft skills: Mentoring, Writing
- Languages: Swedish (Native), English

---
Certifications
---

Certified Data Architect
Example Institute
(Issued: 2021, Expires: 2024, Credential ID: CD-77)
"""
